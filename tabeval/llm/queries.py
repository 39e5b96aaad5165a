"""The registered queries of this subpackage: each operator with production parameters over
its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tabeval.llm import (
    alignment, bytebpe, decontaminate, fingerprint, jaccard, langid, maxent, packing, pieces, quality, resample, secretscan, urls,
)
from tabeval.llm.common import held_out, saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WINDOWS_ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS g
  FROM i, unnest(range(1, greatest(len(w) - 11, 2))) AS t(s) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, len(w) - n + 2)) AS t(s)),
m AS (SELECT DISTINCT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id),
k AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)"""


@register("op1_decontaminate", WINDOWS_ORACLE)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.phrase_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digests(found)


@register("op2_maxent")
def op2_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = docs.where(~held_out("doc_id", 7, 2))
    counts = maxent.token_table(training)
    model = maxent.train(training, counts)
    out = maxent.score(docs, model, counts)
    return out.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known",
                      F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


@register("op3_langid")
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 5, 0).alias("held_out"))
    profiles = langid.learn(docs.where(~F.col("held_out")))
    return langid.identify(docs.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def url_oracle() -> str:
    """The same in SQL: host counts, moment estimates, posteriors, bounds."""
    two = ", ".join(f"'{s}'" for s in urls.TWO_LABEL_SUFFIXES)
    rules = ", ".join(f"('{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for r, v in urls.RULES)
    strength = """(SELECT 1 / greatest(least(CASE WHEN sum(k) > 0 AND sum(k) < sum(n) AND
        sum(n) - count(*) - (sum(n * n) - sum(n)) / sum(n) > 0 THEN
        ((sum(k * k / n) - sum(k) * sum(k) / sum(n)) / (sum(k) / sum(n) * (1 - sum(k) / sum(n))) - (count(*) - 1))
        / (sum(n) - count(*) - (sum(n * n) - sum(n)) / sum(n)) ELSE 0.9 END, 0.9), 0.0001) - 1 FROM %s WHERE n > 0)"""
    split = r"""lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''))"""
    path = r"""coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"""
    return f"""
WITH seen AS (SELECT page_id, url, {split} AS host, {path} AS path FROM pages),
labelled AS (
  SELECT {split} AS host, ((coalesce(quality, 1) = 0) OR (coalesce(toxic, 0) = 1))::INT AS bad
  FROM pages JOIN labels ON doc_id = try_cast(
    nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#0-9]*/([0-9]+)', 1), '') AS BIGINT)
  WHERE quality IS NOT NULL OR toxic IS NOT NULL),
counted AS (
  SELECT host, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM (
    SELECT host, 0 AS n, 0 AS k FROM seen UNION ALL SELECT host, 1, bad FROM labelled) GROUP BY host),
parts AS (
  SELECT *, string_split(host, '.') AS l, CASE WHEN array_to_string(l[-2:], '.') IN ({two})
    THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
    CASE WHEN array_to_string(l[-2:], '.') IN ({two}) THEN array_to_string(l[-3:], '.')
    ELSE array_to_string(l[-2:], '.') END AS domain FROM counted),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM parts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM parts GROUP BY suffix),
root AS (SELECT (1 + sum(k)) / (2 + sum(n)) AS share FROM parts),
power AS (SELECT {strength % 'suffixes'} AS a, {strength % 'domains'} AS b, {strength % 'parts'} AS c),
m1 AS (SELECT suffix, (share * a + k) / (a + n) AS share FROM suffixes, root, power),
m2 AS (SELECT domain, (m1.share * b + k) / (b + n) AS share FROM domains JOIN m1 USING (suffix), power),
m3 AS (SELECT host, n + c + 1 AS size, (m2.share * c + k) / (c + n) AS share FROM parts JOIN m2 USING (domain), power),
method AS (
  SELECT host, CASE WHEN share - 1.645 * sqrt(share * (1 - share) / size) > 0.3 THEN 'block' ELSE 'allow' END AS says
  FROM m3),
rules(rule, verdict, h, p) AS (VALUES {rules}),
fits AS (
  SELECT page_id, host, path, rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC) AS place
  FROM (SELECT DISTINCT page_id, host, path FROM seen) JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, m.says) AS verdict
FROM seen s JOIN method m USING (host)
LEFT JOIN fits f ON f.page_id = s.page_id AND f.host = s.host AND f.path = s.path AND place = 1"""


@register("op4_urls", url_oracle())
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.page_outcomes(pages, table(spark, sf_dir, "labels")))


@register("op5_tokens")
def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(table(spark, sf_dir, "documents"))


@register("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)).select("doc_id", F.col("quality").alias("label"))
    out = quality.score(docs, quality.train(docs, labels))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


LINKS_ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM met JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * m >= 75 * (nx.n + ny.n - m)),
reach AS (SELECT DISTINCT x AS a, x AS b FROM link UNION SELECT a, y FROM reach JOIN link ON b = x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)"""


@register("op7_jaccard", LINKS_ORACLE)
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@register("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(pieces.token_counts(table(spark, sf_dir, "documents")))


@register("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_spans(table(spark, sf_dir, "documents"))


@register("op10_fingerprint")
def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


# crc32 bit by bit over the UTF-8 bytes of the distinct words; the ranks by one window.
RESAMPLE_ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS g FROM benchmark),
dw AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(w) AS g FROM d) GROUP BY 1, 2),
words AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(g)),
    lambda i: ('0x' || substr(hex(g), (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))),
    4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT g FROM dw UNION SELECT g FROM b)),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM dw JOIN words USING (g) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN words USING (g) GROUP BY 1),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range(0, 10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dw JOIN words USING (g) JOIN gain USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM placed) THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)"""


@register("op11_resample", RESAMPLE_ORACLE)
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@register("op12_bytebpe")
def op12_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bytebpe.decode(bytebpe.encode(table(spark, sf_dir, "documents"), packed=True))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = saved(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs"), "alignment")
    return alignment.scored(aligned, saved(alignment.pair_counts(aligned), "pair_counts"))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
