"""Registered preparation queries: split, sample, unions, scaling, balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabeval.operators import balance as bl
from tabeval.operators import scale as sc
from tabeval.operators import split as sp
from tabeval.plans import oracles as orc
from tabeval.plans.queries import register
from tabeval.plans.report import rounded
from tabeval.session import materialize
from tabeval.sources.io import testdata_table

SEED = 2025
TEST_SIZE = 0.3
CATEGORICAL = ["o_orderstatus", "o_orderpriority"]
CONTINUOUS = ["o_totalprice", "o_custkey"]


def orders_split(spark, sf_dir):
    o = testdata_table(spark, sf_dir, "orders")
    return sp.stratified_split(o, "o_orderstatus", TEST_SIZE, SEED, id_col="o_orderkey")


SPLIT_SQL = f"""
x AS (SELECT *, md5(concat('{SEED}', ':', o_orderkey::VARCHAR)) AS key FROM orders),
c AS (SELECT o_orderstatus, count(*) AS c FROM x GROUP BY 1),
sa AS (SELECT *, sum(c) OVER () AS n FROM c),
sa2 AS (SELECT *, n - ceil({TEST_SIZE}::DOUBLE * n) AS n_train FROM sa),
sa3 AS (SELECT *, n_train::DOUBLE * c / n::DOUBLE AS cont FROM sa2),
sa4 AS (SELECT *, floor(cont) AS fl FROM sa3),
sa5 AS (SELECT *, n_train - sum(fl) OVER () AS need,
              row_number() OVER (ORDER BY cont - fl DESC, o_orderstatus ASC NULLS FIRST) AS rk FROM sa4),
alloc AS (SELECT o_orderstatus, fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS train_n FROM sa5),
split AS (
  SELECT x.* EXCLUDE (key),
         CASE WHEN row_number() OVER (PARTITION BY x.o_orderstatus ORDER BY key, o_orderkey) <= alloc.train_n
              THEN 'train' ELSE 'test' END AS split
  FROM x JOIN alloc USING (o_orderstatus))"""


@register("stratified_split", f"WITH {SPLIT_SQL} SELECT o_orderkey, o_orderstatus, split FROM split")
def q_stratified_split(spark, sf_dir):
    return orders_split(spark, sf_dir).select("o_orderkey", "o_orderstatus", "split")


@register("split_sizes", f"WITH {SPLIT_SQL} SELECT split, o_orderstatus, count(*) AS n FROM split GROUP BY 1, 2")
def q_split_sizes(spark, sf_dir):
    return sp.split_sizes(orders_split(spark, sf_dir), "o_orderstatus")


@register("sample_n", f"""
SELECT o_orderkey, o_custkey FROM orders
ORDER BY md5(concat('{SEED}', ':', o_orderkey::VARCHAR)), o_orderkey LIMIT 200""")
def q_sample_n(spark, sf_dir):
    o = testdata_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sp.sample_n(o, 200, SEED, "o_orderkey")


@register("union_tagged", f"""WITH {SPLIT_SQL}
SELECT split || '_set' AS dataset, o_orderkey, o_totalprice FROM split""")
def q_union_tagged(spark, sf_dir):
    s = orders_split(spark, sf_dir).select("o_orderkey", "o_totalprice", "split")
    parts = {"train_set": s.where(F.col("split") == "train").drop("split"),
             "test_set": s.where(F.col("split") == "test").drop("split")}
    return sp.union_tagged(parts, "dataset")


@register("param_compare", f"""WITH {SPLIT_SQL},
a AS (SELECT o_custkey, avg(o_totalprice) AS mean_price, count(*) AS n FROM split WHERE split = 'train' GROUP BY 1),
b AS (SELECT o_custkey, avg(o_totalprice) AS mean_price, count(*) AS n FROM split WHERE split = 'test' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey,
       round(a.mean_price, 6) AS mean_price_train, a.n AS n_train,
       round(b.mean_price, 6) AS mean_price_test, b.n AS n_test
FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey""")
def q_param_compare(spark, sf_dir):
    """Customers of either split side by side: many have orders on one side only."""
    s = orders_split(spark, sf_dir)

    def summary(d):
        return d.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean_price"),
                                                F.count(F.lit(1)).alias("n"))
    a = summary(s.where(F.col("split") == "train"))
    b = summary(s.where(F.col("split") == "test"))
    return rounded(sp.compare_params(a, b, "o_custkey", ("_train", "_test")))


@register("standardise", f"""WITH {SPLIT_SQL},
st AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1,
              avg(o_custkey::DOUBLE) AS m2, stddev_pop(o_custkey::DOUBLE) AS s2 FROM split WHERE split = 'train')
SELECT o_orderkey,
       round((o_totalprice - m1) / CASE WHEN s1 = 0 OR s1 IS NULL THEN 1 ELSE s1 END, 6) AS o_totalprice,
       round((o_custkey::DOUBLE - m2) / CASE WHEN s2 = 0 OR s2 IS NULL THEN 1 ELSE s2 END, 6) AS o_custkey
FROM split, st WHERE split = 'test'""")
def q_standardise(spark, sf_dir):
    s = materialize(orders_split(spark, sf_dir).select("o_orderkey", *CONTINUOUS, "split"), "split")
    train = s.where(F.col("split") == "train")
    test = s.where(F.col("split") == "test").select("o_orderkey", *CONTINUOUS)
    return rounded(sc.standardise(train, test, CONTINUOUS))


@register("balance_counts", f"""WITH {SPLIT_SQL}
SELECT CASE WHEN grouping(split) = 1 THEN 'Overall' ELSE split END AS "group", count(*) AS n
FROM split GROUP BY ROLLUP (split)""")
def q_balance_counts(spark, sf_dir):
    return bl.balance_counts(orders_split(spark, sf_dir), "split")


@register("balance_categorical", f"""WITH {SPLIT_SQL},
lv AS (SELECT split, 'o_orderstatus' AS variable, o_orderstatus::VARCHAR AS level FROM split
       UNION ALL SELECT split, 'o_orderpriority', o_orderpriority::VARCHAR FROM split),
g AS (SELECT variable, level, CASE WHEN grouping(split) = 1 THEN 'Overall' ELSE split END AS "group", count(*) AS n
      FROM lv WHERE level IS NOT NULL GROUP BY GROUPING SETS ((variable, level, split), (variable, level)))
SELECT variable, level, "group", n, round(100.0 * n / sum(n) OVER (PARTITION BY variable, "group"), 6) AS pct
FROM g""")
def q_balance_categorical(spark, sf_dir):
    return rounded(bl.balance_categorical(orders_split(spark, sf_dir), "split", CATEGORICAL))


@register("balance_means", f"""WITH {SPLIT_SQL},
lv AS (SELECT split, 'o_totalprice' AS variable, o_totalprice::DOUBLE AS x FROM split
       UNION ALL SELECT split, 'o_custkey', o_custkey::DOUBLE FROM split)
SELECT variable, CASE WHEN grouping(split) = 1 THEN 'Overall' ELSE split END AS "group", count(x) AS n,
       count(*) - count(x) AS n_missing, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd
FROM lv GROUP BY GROUPING SETS ((variable, split), (variable))""")
def q_balance_means(spark, sf_dir):
    return rounded(bl.balance_means(orders_split(spark, sf_dir), "split", CONTINUOUS))


@register("balance_welch", f"""WITH {SPLIT_SQL},
lv AS (SELECT split, 'o_totalprice' AS variable, o_totalprice::DOUBLE AS x FROM split
       UNION ALL SELECT split, 'o_custkey', o_custkey::DOUBLE FROM split),
m AS (SELECT variable, split, count(x) AS n, avg(x) AS mean, var_samp(x) AS v FROM lv GROUP BY 1, 2),
a AS (SELECT * FROM m WHERE split = 'test'), b AS (SELECT * FROM m WHERE split = 'train')
SELECT a.variable, a.split AS group_a, b.split AS group_b,
       round((a.mean - b.mean) / sqrt(a.v / a.n + b.v / b.n), 6) AS t,
       round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 6)
         AS df
FROM a JOIN b USING (variable)""")
def q_balance_welch(spark, sf_dir):
    return rounded(bl.welch_t(orders_split(spark, sf_dir), "split", CONTINUOUS, with_p=False))


@register("balance_chi2", f"""WITH {SPLIT_SQL},
lv AS (SELECT split, 'o_orderstatus' AS variable, o_orderstatus::VARCHAR AS level FROM split
       UNION ALL SELECT split, 'o_orderpriority', o_orderpriority::VARCHAR FROM split),
obs AS (SELECT variable, level, split, count(*) AS o FROM lv WHERE level IS NOT NULL GROUP BY 1, 2, 3),
lvls AS (SELECT DISTINCT variable, level FROM obs), grps AS (SELECT DISTINCT variable, split FROM obs),
cells AS (SELECT l.variable, l.level, g.split, coalesce(o.o, 0) AS o
          FROM lvls l JOIN grps g USING (variable) LEFT JOIN obs o USING (variable, level, split)),
e AS (SELECT *, (sum(o) OVER (PARTITION BY variable, level))::DOUBLE * sum(o) OVER (PARTITION BY variable, split)
               / sum(o) OVER (PARTITION BY variable) AS e FROM cells),
d AS (SELECT variable, count(DISTINCT level) AS n_levels, count(DISTINCT split) AS n_groups FROM cells GROUP BY 1)
SELECT e.variable, round(sum(power(abs(o - e) - CASE WHEN (n_levels - 1) * (n_groups - 1) = 1
                                                THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e), 6) AS chi2,
       ((n_levels - 1) * (n_groups - 1))::INTEGER AS dof, n_levels, n_groups
FROM e JOIN d USING (variable) GROUP BY e.variable, n_levels, n_groups""")
def q_balance_chi2(spark, sf_dir):
    return rounded(bl.chi2(orders_split(spark, sf_dir), "split", CATEGORICAL, with_p=False))


LV_CAT = """lvc AS (SELECT split, 'o_orderstatus' AS variable, o_orderstatus::VARCHAR AS level FROM split
       UNION ALL SELECT split, 'o_orderpriority', o_orderpriority::VARCHAR FROM split),
obs AS (SELECT variable, level, split, count(*) AS o FROM lvc WHERE level IS NOT NULL GROUP BY 1, 2, 3),
cells AS (SELECT l.variable, l.level, g.split, coalesce(o.o, 0) AS o
          FROM (SELECT DISTINCT variable, level FROM obs) l JOIN (SELECT DISTINCT variable, split FROM obs) g USING (variable)
          LEFT JOIN obs o USING (variable, level, split)),
ex AS (SELECT *, (sum(o) OVER (PARTITION BY variable, level))::DOUBLE * sum(o) OVER (PARTITION BY variable, split)
               / sum(o) OVER (PARTITION BY variable) AS e FROM cells),
dof AS (SELECT variable, (count(DISTINCT level) - 1) * (count(DISTINCT split) - 1) AS dof FROM cells GROUP BY 1),
chi AS (SELECT variable, dof, sum(power(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS x
        FROM ex JOIN dof USING (variable) GROUP BY 1, 2)"""
LV_CON = """lvn AS (SELECT split, 'o_totalprice' AS variable, o_totalprice::DOUBLE AS x FROM split
       UNION ALL SELECT split, 'o_custkey', o_custkey::DOUBLE FROM split),
m AS (SELECT variable, split, count(x) AS n, avg(x) AS mean, var_samp(x) AS v FROM lvn GROUP BY 1, 2),
w AS (SELECT a.variable, (a.mean - b.mean) / sqrt(a.v / a.n + b.v / b.n) AS t,
             power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)) AS df
      FROM m a JOIN m b USING (variable) WHERE a.split = 'test' AND b.split = 'train')"""


@register("balance_table", f"""WITH {SPLIT_SQL}, {LV_CAT}, {LV_CON},
gc AS (SELECT variable, level, split AS g, o FROM cells UNION ALL
       SELECT variable, level, 'Overall', sum(o) FROM cells GROUP BY 1, 2),
ct AS (SELECT variable, level, g, printf('%d (%.1f)', o::BIGINT, 100.0 * o / sum(o) OVER (PARTITION BY variable, g)) AS cell FROM gc),
gm AS (SELECT variable, split AS g, avg(x) AS mean, stddev_samp(x) AS sd FROM lvn GROUP BY 1, 2 UNION ALL
       SELECT variable, 'Overall', avg(x), stddev_samp(x) FROM lvn GROUP BY 1),
mt AS (SELECT variable, g, printf('%.1f (%.1f)', mean, sd) AS cell FROM gm),
miss AS (SELECT variable, count(*) - count(x) AS n_missing FROM lvn GROUP BY 1)
SELECT c.variable, c.level, NULL::BIGINT AS n_missing, max(cell) FILTER (WHERE g = 'Overall') AS "Overall",
       max(cell) FILTER (WHERE g = 'test') AS test, max(cell) FILTER (WHERE g = 'train') AS train,
       CASE WHEN row_number() OVER (PARTITION BY c.variable ORDER BY c.level) = 1
            THEN printf('%.3f', any_value({orc.p_chi2("chi.x", "chi.dof")})) END AS p_value
FROM ct c JOIN chi USING (variable) GROUP BY c.variable, c.level
UNION ALL
SELECT mt.variable, '', any_value(n_missing), max(cell) FILTER (WHERE g = 'Overall'), max(cell) FILTER (WHERE g = 'test'),
       max(cell) FILTER (WHERE g = 'train'), printf('%.3f', any_value({orc.p_student("w.t", "w.df")}))
FROM mt JOIN miss USING (variable) JOIN w USING (variable) GROUP BY mt.variable""")
def q_balance_table(spark, sf_dir):
    """The formatted table with p-values."""
    s = materialize(orders_split(spark, sf_dir).select(*CATEGORICAL, *CONTINUOUS, "split"), "split")
    return bl.balance_table(s, "split", CATEGORICAL, CONTINUOUS, ["test", "train"])


@register("balance_pvalues", f"""WITH {SPLIT_SQL}, {LV_CAT}, {LV_CON}
SELECT variable, 'welch_t' AS test, round({orc.p_student("t", "df")}, 6) AS p_value FROM w
UNION ALL SELECT variable, 'chi2', round({orc.p_chi2("x", "dof")}, 6) FROM chi""")
def q_balance_pvalues(spark, sf_dir):
    s = materialize(orders_split(spark, sf_dir).select(*CATEGORICAL, *CONTINUOUS, "split"), "split")
    t = bl.welch_t(s, "split", CONTINUOUS).select("variable", F.lit("welch_t").alias("test"), "p_value")
    c = bl.chi2(s, "split", CATEGORICAL).select("variable", F.lit("chi2").alias("test"), "p_value")
    return rounded(t.unionByName(c))
