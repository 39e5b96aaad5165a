"""Registered profiling and cleaning queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from tabeval.operators import profile as pr
from tabeval.plans import fixtures as fx
from tabeval.plans.queries import register
from tabeval.plans.report import rounded
from tabeval.sources.io import testdata_table

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_MISSING_SQL = ("SELECT * REPLACE (CASE WHEN l_discount <> 0.0 THEN l_discount END AS l_discount, "
                  "CASE WHEN l_tax <> 0.0 THEN l_tax END AS l_tax) FROM lineitem")


@register("value_counts", """
SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def q_value_counts(spark, sf_dir):
    return pr.value_counts(testdata_table(spark, sf_dir, "orders"), "o_orderpriority")


@register("value_freq", """
SELECT o_orderstatus, count(*) AS count,
       round(count(*)::DOUBLE / (SELECT count(o_orderstatus) FROM orders), 6) AS freq
FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1""")
def q_value_freq(spark, sf_dir):
    return rounded(pr.value_counts(testdata_table(spark, sf_dir, "orders"), "o_orderstatus", normalize=True))


@register("missing_counts", "WITH li AS (" + LI_MISSING_SQL + ") " + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM li" for c in LINEITEM_COLS))
def q_missing_counts(spark, sf_dir):
    return pr.missing_counts(fx.lineitem_missing(spark, sf_dir))


_DTYPE = ("CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
          "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
          "WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower(data_type) END")


@register("schema_profile", "WITH li AS (" + LI_MISSING_SQL + "), nn AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS non_null, count(*) AS n_rows FROM li" for c in LINEITEM_COLS)
    + f"""), ty AS (SELECT column_name AS variable, (ordinal_position - 1)::INTEGER AS position, {_DTYPE} AS dtype
                  FROM information_schema.columns WHERE table_name = 'lineitem')
SELECT ty.position, nn.variable, ty.dtype, nn.non_null, nn.n_rows FROM nn JOIN ty USING (variable)""")
def q_schema_profile(spark, sf_dir):
    return pr.schema_profile(fx.lineitem_missing(spark, sf_dir))


@register("histogram20", """
WITH s AS (SELECT min(l_extendedprice) AS lo0, max(l_extendedprice) AS hi0 FROM lineitem),
e AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
             CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM s),
edges AS (SELECT k, CASE WHEN k = 20 THEN hi ELSE k * ((hi - lo) / 20.0) + lo END AS edge FROM e, range(0, 21) r(k)),
b AS (SELECT least(greatest((SELECT count(*) FROM edges WHERE edge <= l_extendedprice) - 1, 0), 19) AS bin
      FROM lineitem WHERE l_extendedprice IS NOT NULL),
c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin)
SELECT g.k::INTEGER AS bin, round(lo_e.edge, 6) AS lo, round(hi_e.edge, 6) AS hi, coalesce(c.count, 0) AS count
FROM range(0, 20) g(k) JOIN edges lo_e ON lo_e.k = g.k JOIN edges hi_e ON hi_e.k = g.k + 1
LEFT JOIN c ON c.bin = g.k""")
def q_histogram20(spark, sf_dir):
    return rounded(pr.histogram(testdata_table(spark, sf_dir, "lineitem"), "l_extendedprice", bins=20))


@register("quantiles", """
WITH a AS (
  SELECT 'value' AS variable, quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]) AS vs FROM events
  UNION ALL
  SELECT 'user_id', quantile_cont(user_id::DOUBLE, [0.1, 0.25, 0.5, 0.75, 0.9]) FROM events)
SELECT variable, ([0.1, 0.25, 0.5, 0.75, 0.9])[i]::DOUBLE AS q, round(vs[i], 6) AS value FROM a, range(1, 6) r(i)""")
def q_quantiles(spark, sf_dir):
    return rounded(pr.quantiles(testdata_table(spark, sf_dir, "events"), ["value", "user_id"],
                                (0.1, 0.25, 0.5, 0.75, 0.9)))


FENCES_SQL = """
fences AS (
  SELECT 'value' AS variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events
  UNION ALL
  SELECT 'user_id', quantile_cont(user_id::DOUBLE, 0.25), quantile_cont(user_id::DOUBLE, 0.75) FROM events),
f2 AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM fences)"""


@register("iqr_fences", f"""WITH {FENCES_SQL}
SELECT variable, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lower, 6) AS lower,
       round(upper, 6) AS upper FROM f2""")
def q_iqr_fences(spark, sf_dir):
    return rounded(pr.iqr_fences(testdata_table(spark, sf_dir, "events"), ["value", "user_id"]))


@register("iqr_outliers", f"""WITH {FENCES_SQL}
SELECT event_id, event_type, value FROM events, f2
WHERE f2.variable = 'value' AND (value < f2.lower OR value > f2.upper)""")
def q_iqr_outliers(spark, sf_dir):
    ev = testdata_table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return pr.iqr_outliers(ev, "value")


@register("iqr_repair", f"""WITH {FENCES_SQL}
SELECT event_id, CASE WHEN value < f2.lower OR value > f2.upper THEN floor(value / 10)::DOUBLE ELSE value END AS value
FROM events, f2 WHERE f2.variable = 'value'""")
def q_iqr_repair(spark, sf_dir):
    ev = testdata_table(spark, sf_dir, "events").select("event_id", "value")
    return pr.iqr_repair(ev, "value")


@register("iqr_repair_overrides", f"""WITH {FENCES_SQL}
SELECT event_id, CASE WHEN event_id % 97 = 0 THEN user_id::DOUBLE
  WHEN value < f2.lower OR value > f2.upper THEN floor(value / 10)::DOUBLE ELSE value END AS value
FROM events, f2 WHERE f2.variable = 'value'""")
def q_iqr_repair_overrides(spark, sf_dir):
    """The rule, but the caller's value where one is given for the row."""
    ev = testdata_table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    given = ev.where(F.col("event_id") % 97 == 0).select("event_id", F.col("user_id").cast("double").alias("value"))
    return pr.iqr_repair(ev.drop("user_id"), "value", overrides=given, id_col="event_id")


@register("box_stats", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events),
w AS (SELECT min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
             max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
             count(value) AS n FROM events, q)
SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
       round(whisker_lo, 6) AS whisker_lo, round(whisker_hi, 6) AS whisker_hi,
       (SELECT count(*) FROM events WHERE value < whisker_lo OR value > whisker_hi) AS n_fliers, n
FROM q, w""")
def q_box_stats(spark, sf_dir):
    return rounded(pr.box_stats(testdata_table(spark, sf_dir, "events"), "value"))


@register("half_even_round", """
SELECT event_id, value, round_even(value, 0) AS value_rounded FROM events""")
def q_half_even_round(spark, sf_dir):
    ev = testdata_table(spark, sf_dir, "events")
    return ev.select("event_id", "value", pr.half_even("value", 0).alias("value_rounded"))


@register("head_rows", """
SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 5""")
def q_head_rows(spark, sf_dir):
    ev = testdata_table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return pr.head(ev, 5, "event_id")


@register("rows_by_id", f"""WITH {FENCES_SQL},
ids AS (SELECT event_id FROM events, f2 WHERE f2.variable = 'value' AND (value < f2.lower OR value > f2.upper))
SELECT event_id, user_id, event_type, value FROM events WHERE event_id IN (SELECT event_id FROM ids)""")
def q_rows_by_id(spark, sf_dir):
    """Look the flagged rows up again by their ids (left-semi join)."""
    from tabeval.operators.frame import rows_by_id
    ev = testdata_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    ids = pr.iqr_outliers(ev, "value").select("event_id")
    return rows_by_id(ev, ids, "event_id")


@register("to_long", """
SELECT o_orderkey, feature, round(value, 6) AS value FROM (
  SELECT o_orderkey, 'o_totalprice' AS feature, o_totalprice::DOUBLE AS value FROM orders
  UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey::DOUBLE FROM orders)""")
def q_to_long(spark, sf_dir):
    """Wide to long over every order."""
    from tabeval.operators.frame import to_long
    o = testdata_table(spark, sf_dir, "orders")
    return rounded(to_long(o, ["o_orderkey"], ["o_totalprice", "o_custkey"]))
