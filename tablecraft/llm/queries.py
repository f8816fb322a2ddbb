"""The registered queries of the operators, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.llm.centroids import cluster_vectors
from tablecraft.llm.chat import format_turns, read_conversations
from tablecraft.llm.decontaminate import contaminated
from tablecraft.llm.fingerprints import compare_fingerprints
from tablecraft.llm.html_text import extract_pages
from tablecraft.llm.language import identify_languages
from tablecraft.llm.lines import dedup_lines
from tablecraft.llm.mixture import Targets, mix_sources
from tablecraft.llm.near_text import near_duplicates
from tablecraft.llm.near_vectors import near_vectors
from tablecraft.llm.term_audit import audit_sources
from tablecraft.llm.token_files import document_token_counts
from tablecraft.llm.training_order import in_training_order

#: Domains are tiers of sources: the remainder of the source's number by three.
TIERS = {"0": "core", "1": "wide", "2": "rest"}
TARGETS = Targets(domain={"core": 5, "wide": 3, "rest": 2}, lang={"en": 4, "de": 2, "fr": 2, "es": 2}, epochs=2, seed=11)


def tier_of(source):
    number = F.regexp_extract(source, r"(\d+)$", 1)
    return F.when(number == "", F.lit("rest")).otherwise(F.element_at(F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair]), (number.cast("bigint") % 3).cast("string")))


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_read(spark, folder, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_read(spark, folder, "embeddings"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(_read(spark, folder, "documents"))


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(_read(spark, folder, "pages"))


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    given = _read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return read_conversations(format_turns(given.unionByName(extra)))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify_languages(_read(spark, folder, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(_read(spark, folder, "documents").select("doc_id", "text", "lang", "source"), TARGETS, tier_of(F.col("source")))
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return document_token_counts(spark, _read(spark, folder, "documents"))


def op10_training_order(spark: SparkSession, folder: str) -> DataFrame:
    return in_training_order(spark, _read(spark, folder, "documents"))


def op11_source_divergence_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_sources(_read(spark, folder, "documents"))


def op12_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return compare_fingerprints(_read(spark, folder, "documents"))


def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_vectors(_read(spark, folder, "embeddings"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


#: Water filling in closed form: siblings are full in the order of capacity by weight.
def _level(name: str, parent: str, above: str, key: str, weight: str) -> str:
    over = f"PARTITION BY {parent} ORDER BY cap / w, {key}" if parent else f"ORDER BY cap / w, {key}"
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""{name}_cap AS (SELECT {parent + ', ' if parent else ''}{key}, {weight} AS w, 2.0 * sum(t) AS cap FROM leaves GROUP BY ALL),
{name}_run AS (SELECT c.*, a.budget AS above, sum(cap) OVER ({over}) - cap AS full_before, sum(w) OVER ({part}) - sum(w) OVER ({over}) + w AS open_w
  FROM {name}_cap c JOIN {above} a {'USING (' + parent + ')' if parent else 'ON true'}),
{name}_open AS (SELECT *, (above - full_before) / open_w AS lvl FROM {name}_run),
{name} AS (SELECT {parent + ', ' if parent else ''}{key}, least(cap, w * max(lvl) OVER ({part})) AS budget FROM {name}_open)"""


OP8_SQL = f"""WITH sized AS (SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
  CASE WHEN regexp_extract(source, '(\\d+)$', 1) = '' OR source IS NULL THEN 'rest' ELSE ['core', 'wide', 'rest'][CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) % 3 + 1] END AS domain,
  coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS t FROM sized GROUP BY ALL),
root AS (SELECT CAST(sum(t) AS DOUBLE) AS budget FROM leaves),
{_level('dom', '', 'root', 'domain', "CASE domain WHEN 'core' THEN 5.0 WHEN 'wide' THEN 3.0 WHEN 'rest' THEN 2.0 ELSE 1.0 END")},
{_level('lng', 'domain', 'dom', 'lang', "CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END")},
{_level('src', 'domain, lang', 'lng', 'source', '1.0')},
plan AS (SELECT domain, lang, source, t, CAST(floor(budget + 1e-6) AS BIGINT) AS b FROM src JOIN leaves USING (domain, lang, source) WHERE t > 0),
cut AS (SELECT *, CAST(least(b // t, 2) AS BIGINT) AS whole, CASE WHEN b < 2 * t THEN b % t ELSE 0 END AS rest FROM plan WHERE b > 0),
ordered AS (SELECT s.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('11:' || whole || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN cut USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch FROM (
  SELECT *, unnest(range(whole)) AS epoch FROM ordered
  UNION ALL SELECT *, whole AS epoch FROM ordered WHERE rest > 0 AND upto <= rest)"""


def _fraction(n: str, size: str) -> str:
    return f"CAST(1 + (1000000000 * (CAST({n} AS HUGEINT) + 2)) // ({size} + 2 * v) AS BIGINT)"


_APART = "(p - q) * (p - q) // (p + q)"

OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
sized AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS size FROM grp g LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, {_fraction('coalesce(n, 0)', 's.size')} AS p, {_fraction('total', 'l.size')} AS q
  FROM sized s JOIN langs l USING (lang) JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, {_APART} AS value FROM p WHERE n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10"""


def _round(r: int) -> str:
    """Assignment to the centroids of round r, then those of the next round."""
    return f"""a{r} AS MATERIALIZED (SELECT rid, min([list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), j]) AS near FROM k, c{r} c GROUP BY rid),
s{r} AS (SELECT near[2] AS j, i, sum(v[i]) AS s, count(*) AS n FROM a{r} JOIN k USING (rid), range(1, 65) t(i) GROUP BY ALL),
m{r} AS (SELECT j, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (j))"""


OP13_SQL = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS j, list_transform(v, lambda x: CAST(x AS BIGINT)) AS v FROM k QUALIFY j < 40),
{", ".join(_round(r) for r in range(6))},
f AS (SELECT vec_id, near[2] AS j, near[1] AS distance FROM a5 JOIN k USING (rid))
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM f JOIN c5 USING (j)"""


def queries() -> dict:
    named = (op1_minhash_near_dedup, op2_embedding_near_dedup, op3_line_dedup, op4_html_extraction, op5_chat_formatting, op6_language_id, op7_benchmark_decontamination, op8_source_mixing, op9_token_counts, op10_training_order, op11_source_divergence_audit, op12_document_fingerprints, op13_centroid_clustering, pipeline)
    return {fn.__name__: fn for fn in named}


def oracles() -> dict[str, str]:
    return {"op8_source_mixing": OP8_SQL, "op11_source_divergence_audit": OP11_SQL, "op13_centroid_clustering": OP13_SQL}
