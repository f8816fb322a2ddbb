import collections
import hashlib
import pathlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablecraft.llm import chat, common, html_text, language, lines, mixture, near_text, near_vectors, queries, token_files, tokens, training_order
from tablecraft.llm.decontaminate import contaminated
from tablecraft.llm.tokens import tokenizer
from tablecraft.session import scratch_path

DOCS = "doc_id bigint, text string, lang string, source string, node string, bucket string"


def words(seed, n=120):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n)]


def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and extra columns with clashing names."""
    base, long = words(1), " ".join(words(2, 60_000))
    near = base[:60] + ["changed"] + base[61:]
    rows = [
        (1, " ".join(base), "en", "src0"), (2, " ".join(near), "en", "src0"), (3, " ".join(base).upper(), "en", None), (4, None, None, "src1"), (5, "", "en", "src1"),
        (6, " \n\t ", "de", "src2"), (7, long, "de", "src2"), (8, long, None, "src2"), (9, "one two", "fr", "src3"), (10, "one two", "fr", "src3"), (10, "one two", "fr", "src3"),
        (None, " ".join(base), "en", "src0"), (11, "!!! 123 ###", "en", "src4"), (12, " ".join(words(5)), "en", "src4"),
    ]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def multiset(text):
    w = re.findall(r"\w+", (text or "").lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def alike(a, b):
    both = sum(min(n, b[x]) for x, n in a.items())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def groups_by_force(texts, links):
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    one = {int(x): float(w) for x, w in zip(range(400), rng.uniform(0.5, 9, 400))}
    two = {x: w * rng.uniform(0.6, 1) for x, w in one.items() if x > 40} | {x: 3.0 for x in range(500, 540)}
    elements = np.array([*one, *two], np.uint64)
    weights = np.array([*one.values(), *two.values()])
    owners = np.repeat([0, 1], [len(one), len(two)])
    signs = near_text.dart_signatures(elements, weights, owners, 2, 4096)
    true = sum(min(one.get(x, 0), two.get(x, 0)) for x in {*one, *two}) / sum(max(one.get(x, 0), two.get(x, 0)) for x in {*one, *two})
    assert abs((signs[0] == signs[1]).mean() - true) < 0.04


def test_near_texts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: multiset(r.text) for r in docs.select("doc_id", "text").collect()}
    ids = sorted(texts)
    want = groups_by_force(texts, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if alike(texts[a], texts[b]) >= 0.8])
    assert {r.doc_id: r.component_id for r in near_text.near_duplicates(docs).collect()} == want


def test_near_texts_chains(spark):
    """Each text is linked with the next one only, so groups hang on links between members that met other leaders."""
    rng, texts = np.random.default_rng(8), {}
    for chain in range(40):
        words = [f"c{chain}w{i}" for i in range(60)]
        for step, place in enumerate([None, *(rng.permutation(10)[:9] * 6 + 2)]):
            if place is not None:
                words[place] = f"c{chain}s{step}"
            texts[step * 40 + chain] = " ".join(words)
    found = near_text.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.component_id, r.group_size) for r in found} == {i: (i % 40, 10) for i in texts}


def test_near_texts_ask_each_leader_once(spark):
    """A node whose buckets share leaders meets each of them once, whatever the order of the lists, and never itself."""
    met = spark.createDataFrame([(1, 10, [5, 7]), (1, 11, [7, 5]), (1, 12, [5, 1, 9]), (2, 10, [5, 7]), (5, 10, [5])], "node bigint, bucket bigint, leaders array<bigint>")
    assert {r.node: sorted(r.leaders) for r in near_text._asked(met).collect()} == {1: [5, 7, 9], 2: [5, 7], 5: []}


def test_near_texts_odd_rows(spark):
    got = {r.doc_id: (r.component_id, r.kept) for r in near_text.near_duplicates(odd_docs(spark)).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 4: (4, True), 5: (5, True), 6: (6, True), 7: (7, True), 8: (7, False), 9: (9, True), 10: (9, False), 11: (11, True), 12: (12, True)}
    assert near_text.near_duplicates(empty(spark)).count() == 0


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 64))
    rows = [(i, (centre[i % 30] + rng.normal(size=64) * 0.3 * (i % 4)).tolist(), "x") for i in range(240)]
    rows += [(300, rows[7][1], "x"), (301, rows[7][1], "x"), (302, None, "x"), (303, [0.0] * 64, "x"), (304, [float("nan")] * 64, "x"), (305, [None] + [1.0] * 63, "x"), (306, [1.0, 2.0], "x"), (306, [1.0, 2.0], "x"), (307, [], "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, node string")
    good = {i: np.array(v) for i, v, _ in rows if v and len(v) == 64 and i < 302}
    links = [(a, b) for a in good for b in good if a != b and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
    want, part = collections.Counter(a for a, _ in links), groups_by_force({i: 0 for i, _, _ in rows}, links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()}
    assert got == {i: (want[i], part[i], part[i] == i) for i in part}
    assert near_vectors.near_vectors(empty(spark, "vec_id bigint, embedding array<float>")).count() == 0


@pytest.mark.parametrize("width,functions", [(16, 2), (64, 2), (64, 3), (64, 4), (384, 3)])
def test_tables_give_the_wanted_recall(width, functions):
    """Pairs at exactly the threshold, of other random numbers than those the tables were chosen with."""
    tables = near_vectors.tables_for(width, functions, 0.9, 0.99, 5)
    rng = np.random.default_rng(77)
    a, b = rng.normal(size=(700, width)), rng.normal(size=(700, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
    (own_a, more_a), (own_b, more_b) = (near_vectors.polytope_codes(x, tables, functions, 5) for x in (a, b))
    met = [len({*x} & ({*y} | {*q})) + len({*y} & {*p}) > 0 for x, p, y, q in zip(own_a.tolist(), more_a.tolist(), own_b.tolist(), more_b.tolist())]
    assert np.mean(met) > 0.98


def test_near_vectors_lose_no_link_near_the_threshold(spark):
    rng = np.random.default_rng(14)
    base = rng.normal(size=(500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(500, 64))
    side -= (base * side).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.86, 0.94, (500, 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side])
    found = near_vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {r.vec_id: r.n_links for r in found} == dict(enumerate(((unit @ unit.T >= 0.9).sum(1) - 1).tolist()))


def deleted_by_force(docs, least):
    """Every line inside a run of at least ``least`` words that occurred earlier, extended from its first occurrence."""
    read = {d: lines.lines_of(t) for d, t in docs.items()}
    first, out = {}, collections.defaultdict(set)
    spans = {d: lines.windows(h, w, least) for d, (_, h, w) in read.items()}
    for d in sorted(spans):
        for a, b, _ in spans[d]:
            first.setdefault(tuple(read[d][1][a:b]), (d, a))
    for d in sorted(spans):
        for a, b, _ in spans[d]:
            source, at = first[tuple(read[d][1][a:b])]
            if source < d or source == d and a >= at + b - a:
                x, y = lines.extended(read[d][1], read[source][1], a, b, at, source == d)
                out[d].update(read[d][0][i] for i in range(x, y))
    return {d: sorted(x) for d, x in out.items()}


def test_line_dedup(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = {r.doc_id: r.text for r in given.collect()}
    assert {r.doc_id: r.gone for r in lines.repeated_runs(given).drop("sig").collect()} == deleted_by_force(docs, 8)
    passage = "one two three four five\nsix seven eight nine ten"
    small = spark.createDataFrame([(1, f"start\n{passage}\nend one"), (2, f"{passage}\nother"), (3, None), (4, ""), (5, f"x\n\n{passage.upper()} "), (None, passage)], "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_deleted) for r in lines.dedup_lines(small).collect()}
    assert got == {1: (f"start\n{passage}\nend one", 0), 2: ("other", 2), 3: (None, 0), 4: ("", 0), 5: ("x\n", 2), None: (passage, 0)}
    long = "\n".join(" ".join(words(60 + i, 9)) for i in range(20))
    other = "\n".join(" ".join(words(90 + i, 9)) for i in range(20))
    twice = spark.createDataFrame([(1, long), (5, f"{long}\nmore of it"), (5, "short\ntext"), (5, other), (5, other), (6, other)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.text, r.n_deleted) for r in lines.dedup_lines(twice).collect())
    first, second = ((5, other, 0), (5, other, 0)), (6, "", 20)
    assert got == sorted([(1, long, 0), (5, "more of it", 20), (5, "short\ntext", 0), *first, second])
    assert lines.dedup_lines(odd_docs(spark)).count() == 14 and lines.dedup_lines(empty(spark)).count() == 0


def starts_by_force(docs, least):
    """First words of the windows of ``least`` words that occurred earlier without overlap."""
    first, out = {}, collections.defaultdict(list)
    for d in sorted(docs):
        w = [x.lower() for x in re.findall(r"\w+", docs[d] or "")]
        for i in range(len(w) - least + 1):
            source, at = first.setdefault(tuple(w[i : i + least]), (d, i))
            if source != d or i >= at + least:
                out[d].append(i)
    return dict(out)


def test_passages_inside_lines(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = starts_by_force({r.doc_id: r.text for r in given.collect()}, 50)
    assert want and {r.doc: r.starts for r in lines.repeated_passages(given).collect()} == want
    p, q = " ".join(words(31, 60)), " ".join(words(32, 20))
    texts = {1: f"{q} before {p}, behind.", 2: f"other start, {p.title()} and on\nlast line", 3: f"x {p} {q} y", 4: f"{q} before {p}, behind.", 5: f"{p[: len(p) // 2]}", 6: "z " + p.replace(" ", "\n", 40) + " z"}
    got = {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in lines.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == {1: (texts[1], 1, 0), 2: ("other start, and on\nlast line", 2, 1), 3: (f"x {q} y", 1, 1), 4: ("", 1, 1), 5: (texts[5], 1, 0), 6: ("z\nz", 41, 41)}


def test_words_of_all_scripts_have_one_hash():
    texts = ["Plain words, it's 12 of_them", "PLAIN İstanbul words istanbul", "ΑΣ ΑΣ'Β Σ plain", "\U0001f600 plain\U0001f600words \U00010400x", "Ünï ĳ K k plain\n\nlast line\x85words"]
    known, of = {}, {}
    for text in texts:
        want = [[x.lower() for x in re.findall(r"\w+", line)] for line in text.split("\n")]
        hashes, breaks = lines.words_in(text)
        assert breaks.tolist() == np.cumsum([len(x) for x in want]).tolist()
        for word, value in zip((w for x in want for w in x), hashes.tolist(), strict=True):
            assert known.setdefault(word, value) == value and of.setdefault(value, word) == word


def test_line_dedup_leaves_no_shuffle_files_and_numbers_texts(spark):
    """Equal texts under one id are one; places order texts by id and text hash, whatever their ids."""
    texts = lines.read_texts(spark.createDataFrame([(2**62, "b c"), (-(2**62), "a"), (7, "x y z"), (7, "x y z"), (7, "other"), (8, None), (None, "a")], "doc_id bigint, text string"))
    rows = texts.orderBy("key").collect()
    assert [r.doc for r in rows] == [-(2**62), 7, 7, 2**62] and rows[1].sig < rows[2].sig and all(r.key % (1 << lines.PLACES) == 0 for r in rows)
    assert len({r.key for r in rows}) == 4 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    given = spark.createDataFrame([(i, f"some line of text {i % 9}") for i in range(2000)], "doc_id bigint, text string")
    before = len(list(pathlib.Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*")))
    common.saved(given.repartition(3, "text"), "probe")
    after = len(list(pathlib.Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*")))
    assert after <= before


PAGES = [
    (None, ""), ("", ""), ("<p>", ""), ("just a few plain words that stand alone in a page without any markup at all here", None),
    ("<html><head><title>no</title><script>var a='<p>x</p>';</script></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>First\n  part<br>second&nbsp;part.<p>Last.</article><div class='comments'><p>I am the first to say something here</p></div><footer>c</footer>", "A & B\nFirst part second part.\nLast."),
    ("<body><div class=cookie-notice>We use cookies on this page for you</div><main><p>Kept text.</p><form>Mail <input></form><aside>Not this one</aside><p>Also <a href=#>kept</a> text</p></main>", "Kept text.\nAlso kept text"),
]


def test_page_text(spark):
    df = spark.createDataFrame([(i, None, page, "n") for i, (page, _) in enumerate(PAGES)], "page_id bigint, url string, html string, text string")
    for row in html_text.extract_pages(df).collect():
        want = PAGES[row.page_id][1]
        assert row.n_chars == len(row.text) and (want is None or row.text == want), row
    assert html_text.extract_pages(empty(spark, "page_id bigint, url string, html string")).count() == 0


LONG = "Plain words that tell what came to pass in the town on that day and who had seen it all."
#: Pages without article and main, furniture without names, and what is their main text.
BARE = [
    [("a", "Home"), ("a", "News today"), ("h1", "A title"), ("p", f"{LONG} See <a href=x>this one here</a> too."), ("h2", "Short head"), ("p", LONG), ("p", f"{LONG} <a href=x>Six words that are all linked</a> {LONG}"), ("a", "Back to top"), ("n", "All rights to this page are kept by us"), ("a", "Help")],
    [("a", "Home"), ("n", "Get our weekly letter by mail each Monday"), ("a", "Shop"), ("a", "Sign in"), ("p", LONG), ("p", "He said no."), ("p", LONG), ("a", "More"), ("a", "Less")],
    [("p", LONG), ("a", "More of it"), ("p", f"{LONG} {LONG}")],
    [("h1", "One"), ("p", LONG), ("p", "It went on."), ("p", f"{LONG} <a href=x>Two words</a>")],
]


def test_page_text_by_neighbours():
    def splits(tree):
        return {tree[0]} | splits(tree[2]) | splits(tree[3]) if isinstance(tree, tuple) else set()

    assert splits(html_text.default_tree()) & {6, 8} and splits(html_text.default_tree()) & {7, 9}
    for page in BARE:
        shown = "".join(f"<div><a href=x>{t}</a></div>" if k == "a" else f"<div>{t}</div>" if k == "n" else f"<{k}>{t}</{k}>" for k, t in page)
        want = [re.sub("<[^>]*>", "", t) for k, t in page if k not in "an"]
        assert html_text.main_text(f"<body>{shown}</body>") == "\n".join(want)
    rng = np.random.default_rng(1)
    for _ in range(500):
        words = rng.integers(1, 60, rng.integers(1, 12))
        marks = rng.choice(["m", "mh", "ml", "b", "bh", "bl"], len(words))
        rows = html_text.features([(int(n), int(n * rng.choice([0, 0.2, 0.5, 1])), frozenset(m)) for n, m in zip(words, marks)])
        assert [html_text.judge(html_text.default_tree(), row) >= 0.5 for row in rows] == ["m" in m for m in marks]


def test_page_text_of_named_wrappers():
    for page in (
        f"<body class='single-post has-sidebar'><p>{LONG}</p></body>", f"<body class='no-right-sidebar'><article><p>{LONG}</article>", f"<div class=content-with-sidebar><p>{LONG}</p></div>",
        f"<article class='post related'><p>{LONG}</article>", f"<section id=legal><article><p>{LONG}</article></section>", f"<html class=no-overlay><main class=content-menu><p>{LONG}</main>",
        f"<div class=widget><main><p>{LONG}</main></div>", f"<article><p>{LONG}</article><div id=comments><article class=comment><p>Not {LONG}</article></div><div class=sidebar><p>Nor {LONG}</div>",
        f"<main><p>{LONG}</main><nav><div class=menu><article><p>Not {LONG}</article></div></nav><aside><article><p>Nor {LONG}</article></aside>",
    ):
        assert html_text.main_text(page) == LONG, page


def test_chat_round_trip(spark):
    texts = ["plain", "\\### Assistant: </turn> ok", "#### a\\\\ </turn></turn \\#", None, "", "é😀" * 40_000, "##\\", "### User: x"]
    rows = [(c, t, role, texts[(c + t) % 8], "z") for c in range(8) for t, role in enumerate(["user", "assistant", None, "as:sist#ant"])]
    rows += [(None, 0, "user", "a", "z"), (3, None, "assistant", "first", "z"), rows[0]]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, ids string"))
    want = collections.defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want[c].append((role or "", text or ""))
    for row in chat.read_conversations(turns).collect():
        said = "".join(x for r, x in want[row.conv_id] if r == "assistant")
        assert row.n_turns == len(want[row.conv_id])
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in want[row.conv_id]).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    for text in filter(None, texts):
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text and "##" not in hidden and "</turn" not in hidden


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in language.identify_languages(docs).collect()]
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98 and np.mean([r.rejected for r in rows]) < 0.01


def test_language_odd_rows(spark):
    got = {r.doc_id: r for r in language.identify_languages(odd_docs(spark)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (4, 5, 6, 11))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify_languages(empty(spark)).count() == 0
    long = "straße " * 60_000
    assert language.bucket_counts(long).sum() == sum(len(language.subwords(language.codes_of(f" {long} "))) for _ in [0])


def test_language_sample_is_bounded_and_leaves_no_language_out(spark):
    """All rows of a language under one id, and copies of one row, which have one hash."""
    rows = [(4, f"der text nummer {i} ist ein deutscher satz", "de") for i in range(900)] + [(i * 4, f"this is english text number {i}", "en") for i in range(60)]
    rows += [(8, "le texte est en français", "fr")] * 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").filter(~language.held_out())
    model = language.fit_language_model(docs, per_language=50)
    assert sorted(model.languages) == sorted({r.lang for r in docs.select("lang").distinct().collect()})


def test_mixing_spreads_rows_without_id(spark):
    """Null ids take places by their text; of repeated ids the same texts are chosen again, however the rows are dealt."""
    rows = [(None, f"one two three {i}", "en", "web 1") for i in range(200)] + [(7, f"four five {i}", "en", "web 1") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    targets = mixture.Targets(share=0.5, seed=3)
    chosen = [sorted(r.text for r in mixture.mix_sources(docs.repartition(n, *by), targets, F.lit("d")).collect()) for n, by in ((1, ()), (5, ("text",)))]
    assert chosen[0] == chosen[1] and 0 < sum(len(t.split()) for t in chosen[0]) <= 0.5 * (200 * 4 + 50 * 3)
    assert any(t.startswith("one") for t in chosen[0]) and sum(t.startswith("one") for t in chosen[0]) < 200


def test_contamination_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    marks = {r.item_id: re.findall(r"\w+", r.text.lower()) for r in items.collect()}
    whole = {(d.doc_id, i) for d in docs.collect() for i, m in marks.items() if f" {' '.join(m)} " in f" {' '.join(re.findall(chr(92) + 'w+', (d.text or '').lower()))} "}
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(docs, items).collect()}
    assert whole <= set(got) and all(x >= 0.8 for x in got.values())
    base = words(1, 100)
    bench = spark.createDataFrame([(1, " ".join(base)), (2, "one two"), (3, None), (4, ""), (None, "one two"), (5, " ".join(words(99)))], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in contaminated(odd_docs(spark), bench).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (None, 1), (9, 2), (10, 2)}
    assert contaminated(odd_docs(spark), empty(spark, "item_id bigint, text string")).count() == 0 and contaminated(empty(spark), bench).count() == 0


def test_budgets_and_prefixes(spark):
    leaves = [(("a", "en", "x"), 100), (("a", "en", "y"), 10), (("b", "en", "z"), 1000)]
    got = mixture.plan_budgets(leaves, mixture.Targets(budget=400, epochs=2))
    assert got == {("a", "en", "x"): 180, ("a", "en", "y"): 20, ("b", "en", "z"): 200}
    assert mixture.plan_budgets(leaves, mixture.Targets(budget=900, epochs=1)) == {("a", "en", "x"): 100, ("a", "en", "y"): 10, ("b", "en", "z"): 790}
    rows = mixture.mix_sources(odd_docs(spark).drop("node"), mixture.Targets(epochs=2, share=0.7), F.lit("all")).collect()
    assert rows and sum(r.mix_tokens for r in rows) <= 0.7 * 120_500
    assert mixture.mix_sources(empty(spark), mixture.Targets(), F.lit("all")).count() == 0


def test_token_files_and_blocks(spark):
    docs, encode = odd_docs(spark), tokenizer().coder.encode_ordinary
    want = sorted((r.doc_id or -1, len(encode(r.text or ""))) for r in docs.collect())
    order = token_files.write_token_files(docs.coalesce(2), scratch_path(spark, "files"))
    order.write.parquet(kept := scratch_path(spark, "order"))
    order = spark.read.parquet(kept)
    for block in (997, 1 << 20):
        counted = order.join(token_files.token_counts(order.select("path"), block_tokens=block), ["path", "ordinal"])
        assert sorted((r.doc_id or -1, r.n_tokens) for r in counted.collect()) == want
    tiny = scratch_path(spark, "tiny").removeprefix("file://") + ".bin"
    np.array([5, 6, 50256, 50256, 7, 8, 9], np.uint16).tofile(tiny)
    got = token_files.token_counts(spark.createDataFrame([(tiny,), (None,)], "path string"), block_tokens=2).collect()
    assert sorted((r.ordinal, r.start, r.n_tokens, r.ended) for r in got) == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 3, False)]


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4096, 4097):
        assert sorted(training_order.feistel(np.arange(n), n, 9).tolist()) == list(range(n))


def test_split_without_look_ahead():
    blanks = [" ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000"]
    texts = ["", "a", "  ", " a  b", "It's  'll we've\n\n\n  done", "x" + " " * 70_000 + "y", "end" + "\n" * 70_000]
    random = np.random.default_rng(4)
    texts += ["".join(random.choice([*blanks, " ", " ", "a", "word", "12", "'s", "!?", "é", "語", "\U0001f600"], 40)) for _ in range(300)]
    coder = tokenizer().coder
    for text, loose in zip(texts, tokens.spaced(pa.array(texts))):
        assert (want := coder.encode_ordinary(text)) == tokenizer().ids(text, loose) == tokenizer().ids(text)
        assert loose or coder.encode_ordinary(text) == tokenizer().plain.encode_ordinary(text)
        assert tokenizer().count(text, loose) == len(want)


def test_training_order_round_trip(spark):
    docs, path = odd_docs(spark), scratch_path(spark, "order")
    docs.write.parquet(given := scratch_path(spark, "docs"))
    docs = spark.read.parquet(given)
    training_order.materialise(docs, path, length=64, shard_records=500).collect()
    records = training_order.read_slots(path, 0, 10**6, 64, 500)
    again = np.concatenate([training_order.read_slots(path, 0, 333, 64, 500), training_order.read_slots(path, 333, 10**6, 64, 500)])
    assert (records == again).all()
    got = collections.defaultdict(list)
    for r in sorted(records, key=lambda r: (r["doc"], r["piece"])):
        got[int(r["doc"])] += r["ids"][: r["n"]].tolist()
    want = collections.defaultdict(list)
    for row in docs.collect():
        want[training_order.NO_ID if row.doc_id is None else row.doc_id] += tokenizer().coder.encode_ordinary(row.text or "") + [50256]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert training_order.in_training_order(spark, empty(spark)).count() == 0
    spark.createDataFrame([(-1, "one"), (None, "two")], "doc_id bigint, text string").write.parquet(few := scratch_path(spark, "docs"))
    assert {r.doc_id for r in training_order.in_training_order(spark, spark.read.parquet(few)).collect()} == {-1, None}


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, folder).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    left = {r.doc_id for r in rows}
    assert left <= set(docs) and sorted(r.slot for r in rows) == list(range(len(rows)))
    sets = {i: multiset(docs[i]) for i in left}
    ids = sorted(left)
    assert not any(alike(sets[a], sets[b]) >= 0.8 for i, a in enumerate(ids) for b in ids[i + 1 :])
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r.n_tokens)
    for i, n in pieces.items():
        assert sum(n) % (len(tokenizer().coder.encode_ordinary(docs[i])) + 1) == 0
    assert set(queries.oracles()) <= set(queries.queries())


def test_near_duplicates_keep_one_row_per_node_of_a_bucket_in_every_round(spark, monkeypatch):
    import itertools

    parts = [" ".join(f"w{p}x{i}" for i in range(12)) for p in range(12)]
    chosen = list(itertools.combinations(range(12), 8))[::6]
    docs = spark.createDataFrame([(n, " ".join(parts[p] for p in c)) for n, c in enumerate(chosen)], "doc_id bigint, text string")
    sizes, plain = {}, near_text.saved

    def spied(df, label):
        made = plain(df, label)
        sizes.setdefault(label, []).append(made.count())
        return made

    monkeypatch.setattr(near_text, "saved", spied)
    found = near_text.near_duplicates(docs).collect()
    assert len(found) == len(chosen) and all(r.kept for r in found)
    assert len(sizes["met"]) > 1 and all(met <= live for met, live in zip(sizes["met"], sizes["live"]))
