import collections
import hashlib
import math
import re

import numpy as np
import pytest

from tablecraft.llm import centroids, fingerprints, term_audit
from tests.llm.test_operators import empty, odd_docs, words


def audit_by_force(rows, least=10, top=10):
    """All of the audit from dense dictionaries and Python integers."""
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    read = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)), g, s) for t, g, s in rows]
    out = set()
    for lang in {g for _, g, _ in read}:
        docs = [(w, s) for w, g, s in read if g == lang]
        held = collections.Counter(t for w, _ in docs for t in set(w))
        kept = [t for t, n in held.items() if n >= least]
        count = collections.defaultdict(collections.Counter)
        for w, s in docs:
            count[s].update(w)
            count[None].update(w)

        def share(s, t):
            return 1 + 10**9 * (count[s][t] + 2) // (sum(count[s][x] for x in kept) + 2 * len(kept))

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        p = {s: {t: share(s, t) for t in kept} for s in [*{s for _, s in docs}, None]}
        for s in {s for _, s in docs}:
            pairs = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode()) for o in {o for _, o in docs} - {s}]
            terms = [(-apart(p[s][t], p[None][t]), t.encode()) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -value, rank + 1) for rank, (value, item) in enumerate(found)}
    return out


def test_terms_of_a_text():
    text = "AbÉ c-d\x00AB\n" + "z" * 5 + " x [Q]"
    want = collections.Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "abÉ c-d\x00ab\nzzzzz x [q]"))
    assert term_audit.document_terms(text.encode()) == collections.Counter({k.encode(): n for k, n in want.items()})
    long = " ".join(words(3, 300_000))
    assert term_audit.document_terms(long.encode()) == collections.Counter(long.encode().split())


def test_audit_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    names = [f"w{i}" for i in range(60)] + ["über", "中文", "A", "a"]
    rows = []
    for i in range(400):
        source = f"s{rng.integers(0, 6) * (i % 3 > 0)}"
        weight = rng.dirichlet(np.full(len(names), 0.2 + (source == "s0")))
        rows.append((" ".join(rng.choice(names, 30, p=weight)), ["en", "de", None][i % 7 % 3], source if i % 40 else None))
    rows += [(None, "fr", "x"), ("", "fr", "y"), ("one", "fr", "y"), ("!!", "en", "quiet"), (None, None, None)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "text string, lang string, source string, n int, term string")
    for least in (10, 40):
        got = {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in term_audit.audit_sources(df, least_docs=least).collect()}
        assert got == audit_by_force(rows, least)


def test_audit_spills_tallies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(term_audit, "TALLY", 5)
    monkeypatch.setattr(term_audit, "CELLS", 7)
    rows = [(" ".join(words(i % 4, 12)), "en", f"s{i % 3}") for i in range(48)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    block = term_audit.pa.RecordBatch.from_pylist([{"lang": "en", "held": [{"source": s, "p": p, "p0": 3} for s, p in (("a", 9 + i), ("b", 40), ("c", 7))]} for i in range(20)])
    found = collections.Counter()
    for batch in term_audit._shared_terms(block):
        for r in batch.to_pylist():
            found[r["source"], r["item"]] += r["value"]
    f = lambda p, q: (p - q) ** 2 // (p + q)
    assert found["a", "b"] == sum(f(9 + i, 40) - f(9 + i, 3) - f(3, 40) for i in range(20)) and len(found) == 3
    got = {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in term_audit.audit_sources(df).collect()}
    assert got == audit_by_force(rows)


def test_audit_odd_rows(spark):
    rows = [(r.text, r.lang, r.source) for r in odd_docs(spark).collect()]
    got = {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in term_audit.audit_sources(odd_docs(spark), least_docs=2).collect()}
    assert got == audit_by_force(rows, 2)
    assert term_audit.audit_sources(empty(spark)).count() == 0


def shingle_set(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(2)
    errors = []
    for share in (0.1, 0.3, 0.5, 0.8, 0.95):
        for _ in range(40):
            pool = rng.integers(0, 1 << 64, 900, np.uint64)
            n = int(600 * 2 * share / (1 + share))
            a, b = pool[:600], np.concatenate([pool[:n], pool[600 : 1200 - n]])
            s = fingerprints.signatures([a, b])
            errors.append(fingerprints.likeness(s[0], s[1]) - fingerprints.jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05 and np.max(np.abs(errors)) < 0.2


def test_fingerprints_equal_brute_force(spark):
    rows = [(r.doc_id, r.text or "") for r in odd_docs(spark).collect()] + [(20 + i, " ".join(words(i % 5, 30 + i))) for i in range(40)]
    rows += [(70, "\U0001f600éx" * 7), (71, "ab"), (-5, "first of all, the smallest id")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, h string, stretch string")

    def key(row):  # ascending: null ids last
        return row[0] is None, row[0] or 0

    order = sorted(rows, key=key, reverse=True)
    for stretch in (5, 1000):
        got = fingerprints.compare_fingerprints(df, stretch=stretch).collect()
        assert sorted(((r.doc_id, r.n_chars) for r in got), key=str) == sorted(((d, len(t)) for d, t in rows), key=str)
        own = {}
        for (doc, text), (_, following) in zip(order, order[1:] + order[:1]):
            half = len(text) // 2
            new = text[: len(text) - half] + following[:half]
            r = next(r for r in got if r.doc_id == doc and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest())
            assert own.setdefault(text, r.fingerprint) == r.fingerprint
            assert r.jaccard_edited == alike(shingle_set(text), shingle_set(new)) and r.jaccard_next == alike(shingle_set(text), shingle_set(following))
            assert abs(r.near_edited - r.jaccard_edited) < 0.25 and abs(r.near_next - r.jaccard_next) < 0.25 and 0 <= r.near_edited <= 1
    alone = spark.createDataFrame([(1, "one two three four five six")], "doc_id bigint, text string")
    assert fingerprints.compare_fingerprints(alone).collect()[0].near_next == 1.0
    assert fingerprints.compare_fingerprints(empty(spark)).count() == 0


def test_matches_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingle_set(r.text or "") for r in docs.collect()}
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_texts(docs).collect()}
    width = 2 * fingerprints.BAND_SLOTS
    bands = {d: {(i, p[i * width : (i + 1) * width]) for i in range(fingerprints.BANDS)} for d, p in prints.items()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    same = {t: min(d for d in texts if texts[d] == t) for t in set(texts.values())}
    want = {}
    for d in texts:
        low = same[texts[d]]
        firsts = {min(o for o in set(same.values()) if b in bands[o]) for b in bands[low]} if sets[d] else set()
        want[d] = min([low, *(f for f in firsts if f < low and alike(sets[f], sets[low]) >= 0.8)])
    got = {r.doc_id: r.match_id for r in fingerprints.match_texts(docs).collect()}
    assert got == want and any(m != same[texts[d]] for d, m in got.items())
    odd = {r.doc_id: r.match_id for r in fingerprints.match_texts(odd_docs(spark)).collect()}
    assert odd == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, 10: 9, 11: 11, 12: 12}
    assert fingerprints.match_texts(empty(spark)).count() == 0


def clusters_by_force(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        parts = collections.defaultdict(list)
        for _, v in kept:
            parts[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(parts[j]) for x in zip(*parts[j])] if parts[j] else c for j, c in enumerate(centres)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, d, j in found:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=64) + 3 * (i % 9)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(5, rows[5][1]), (7, [0.0] * 64), (None, [1.0] * 64), (400, None), (401, []), (402, [1.0] * 63), (403, [None] + [1.0] * 63), (404, [float("nan")] * 64), (405, [float("inf")] + [0.0] * 63)]
    schema = "vec_id bigint, embedding array<float>, cluster string, v int"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    for k in (40, 3, 1000):
        got = sorted((tuple(r) for r in centroids.cluster_vectors(df, clusters=k).collect()), key=str)
        assert got == clusters_by_force(rows, k, 5)
    assert centroids.cluster_vectors(empty(spark, schema)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64)], "vec_id bigint, embedding array<double>"))


def test_dot_products_follow_changes():
    rng = np.random.default_rng(1)
    v, old = rng.integers(-900, 900, (50, 16)), rng.integers(-900, 900, (7, 16))
    new = old.copy()
    new[2, 3] += 5
    new[4] = rng.integers(-900, 900, 16)
    assert (centroids.changed(v @ old.T, v, new - old) == v @ new.T).all()


