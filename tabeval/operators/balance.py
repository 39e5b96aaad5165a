"""Group-balance table (a 'Table 1'): counts, n (%) per level, mean (SD), missing
counts, Welch t-test for continuous and Pearson chi-square for categorical
variables (Yates' correction only for 2x2 tables).

All variables of a kind are handled in one pass (``explode`` of one struct per
variable); the overall column is put together from the groups' reductions.  Statistics are computed in Spark; the p-value tail is a
vectorised UDF over the per-variable result rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabeval.functions.tails import chi2_pvalue, t_pvalue
from tabeval.session import materialize

OVERALL = "Overall"


def balance_counts(df: DataFrame, group: str) -> DataFrame:
    """(group, n) for each group and 'Overall': the rows are counted once, the counts rolled up."""
    n = df.groupBy(F.col(group).cast("string").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    return n.rollup("group").agg(F.sum("n").alias("n"), F.when(F.grouping("group") == 1, F.lit(OVERALL))
                                 .otherwise(F.col("group")).alias("_g")).select(F.col("_g").alias("group"), "n")


def _levels(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(group, variable, level STRING) per row and categorical variable, NULL levels dropped."""
    u = df.select(F.col(group).cast("string").alias("group"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in columns])).alias("_u"))
    return u.select("group", "_u.variable", "_u.level").where(F.col("level").isNotNull())


def level_counts(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(variable, level, group, n): the one reduction behind the categorical rows and chi-square."""
    return _levels(df, group, columns).groupBy("variable", "level", "group").agg(F.count(F.lit(1)).alias("n"))


def balance_categorical(df: DataFrame, group: str, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """(variable, level, group, n, pct): pct of the non-missing rows of the variable in the group."""
    g = counts if counts is not None else level_counts(df, group, columns)
    g = g.groupBy("variable", "level").agg(F.collect_list(F.struct("group", "n")).alias("_x"), F.sum("n").alias("_n"))
    both = F.concat("_x", F.array(F.struct(F.lit(OVERALL).alias("group"), F.col("_n").alias("n"))))
    g = g.select("variable", "level", F.explode(both).alias("_x")).select("variable", "level", "_x.group", "_x.n")
    tot = F.sum("n").over(Window.partitionBy("variable", "group"))
    return g.withColumn("pct", F.lit(100.0) * F.col("n") / tot)


def balance_means(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(variable, group, n, n_missing, mean, sd): SD with n-1.  One pass over the rows; the
    overall row is put together from the groups' counts, means and squared deviations."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"), F.var_pop(x).alias(f"{c}__var")]
    g = df.groupBy(F.col(group).cast("string").alias("group")).agg(*aggs)
    g = g.select("group", F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"{c}__n").alias("n"), (F.col("_rows") - F.col(f"{c}__n")).alias("n_missing"),
                 F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__var").alias("var")) for c in columns])).alias("_s"))
    g = g.select("_s.variable", "group", "_s.n", "_s.n_missing", "_s.mean", (F.col("_s.var") * F.col("_s.n")).alias("ss"))
    all_ = Window.partitionBy("variable")
    mean = F.sum(F.col("n") * F.col("mean")).over(all_) / F.sum(F.when(F.col("n") > 0, F.col("n"))).over(all_)
    o = g.withColumn("_all", mean).groupBy("variable").agg(
        F.lit(OVERALL).alias("group"), F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"),
        F.first("_all").alias("mean"), F.sum(F.col("ss") + F.col("n") * F.pow(F.col("mean") - F.col("_all"), 2)).alias("ss"))
    out = g.unionByName(o)
    return out.select("variable", "group", "n", "n_missing", "mean",
                      F.when(F.col("n") > 1, F.sqrt(F.col("ss") / (F.col("n") - 1))).alias("sd"))


def welch_t(df: DataFrame, group: str, columns: Sequence[str], with_p: bool = True,
            means: DataFrame | None = None) -> DataFrame:
    """(variable, group_a, group_b, t, df[, p_value]) for two groups; a = the smaller label."""
    m = (means if means is not None else balance_means(df, group, columns)).where(F.col("group") != OVERALL)
    m = m.withColumn("_v", F.col("sd") * F.col("sd"))
    s = F.struct("group", "n", "mean", "_v")
    p = m.groupBy("variable").agg(F.min_by(s, F.col("group")).alias("a"), F.max_by(s, F.col("group")).alias("b"),
                                  F.count(F.lit(1)).alias("_k"))
    va = F.col("a._v") / F.col("a.n")
    vb = F.col("b._v") / F.col("b.n")
    t = F.try_divide(F.col("a.mean") - F.col("b.mean"), F.sqrt(va + vb))
    dof = F.try_divide((va + vb) * (va + vb),
                       F.try_divide(va * va, F.col("a.n") - 1) + F.try_divide(vb * vb, F.col("b.n") - 1))
    out = p.where(F.col("_k") == 2).select("variable", F.col("a.group").alias("group_a"),
                                           F.col("b.group").alias("group_b"), t.alias("t"), dof.alias("df"))
    return out.withColumn("p_value", t_pvalue("t", "df")) if with_p else out


def chi2(df: DataFrame, group: str, columns: Sequence[str], correction: bool = True,
         with_p: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """(variable, chi2, dof, n_levels, n_groups[, p_value]): Pearson chi-square of the
    level x group table; Yates' correction (capped at |O-E|) only when dof = 1.

    Aggregations only, over the observed cells; the table is never filled out:
    without correction chi2 = sum(O^2/E) - N over observed cells (an empty cell adds
    nothing), and in a 2x2 table every cell has the same |O-E| = d, so the corrected
    statistic is max(d - 1/2, 0)^2 * N^3 / (r1 r2 c1 c2).
    """
    counts = counts if counts is not None else materialize(level_counts(df, group, columns), "levels")
    obs = counts.withColumnRenamed("n", "o")
    rows = obs.groupBy("variable", "level").agg(F.sum("o").alias("r"))
    cols = obs.groupBy("variable", "group").agg(F.sum("o").alias("c"))
    per_var = (rows.groupBy("variable").agg(F.count(F.lit(1)).alias("n_levels"), F.sum("r").alias("n"),
                                            F.product("r").alias("_rprod"))
               .join(cols.groupBy("variable").agg(F.count(F.lit(1)).alias("n_groups"),
                                                   F.product("c").alias("_cprod")), "variable"))
    cells = (obs.join(rows, ["variable", "level"]).join(cols, ["variable", "group"]).join(per_var, "variable")
                .withColumn("e", F.col("r").cast("double") * F.col("c") / F.col("n")))
    g = cells.groupBy("variable", "n_levels", "n_groups", "n", "_rprod", "_cprod").agg(
        F.sum(F.col("o").cast("double") * F.col("o") / F.col("e")).alias("_s"),
        F.max(F.abs(F.col("o") - F.col("e"))).alias("_d"))
    dof = (F.col("n_levels") - 1) * (F.col("n_groups") - 1)
    n = F.col("n").cast("double")
    plain = F.col("_s") - n
    yates = (F.pow(F.greatest(F.col("_d") - F.lit(0.5), F.lit(0.0)), 2) * n * n * n
             / (F.col("_rprod").cast("double") * F.col("_cprod").cast("double")))
    stat = F.when(dof == 1, yates).otherwise(plain) if correction else plain
    out = g.select("variable", stat.alias("chi2"), dof.cast("int").alias("dof"), "n_levels", "n_groups")
    return out.withColumn("p_value", chi2_pvalue("chi2", "dof")) if with_p else out


def balance_table(df: DataFrame, group: str, categorical: Sequence[str], continuous: Sequence[str],
                  groups: Sequence[str]) -> DataFrame:
    """The formatted table: (variable, level, missing, Overall, <group>..., p_value).

    ``groups`` names the group columns of the output (a handful of labels).
    Categorical cells are 'n (pct)' with one decimal; continuous 'mean (sd)'; the
    p-value sits on the first level of a categorical variable, formatted to 3 places.
    """
    labels = [OVERALL] + list(groups)
    # everything below comes from these two reductions of the rows
    counts = materialize(level_counts(df, group, categorical), "levels")
    means = materialize(balance_means(df, group, continuous), "means")
    cat = balance_categorical(df, group, categorical, counts).withColumn(
        "cell", F.format_string("%d (%.1f)", F.col("n"), F.col("pct")))
    cat = cat.groupBy("variable", "level").pivot("group", labels).agg(F.first("cell"))
    # a level seen overall but not in a group is a zero count there
    cat = cat.select("variable", "level", *[F.coalesce(F.col(g), F.lit("0 (0.0)")).alias(g) for g in labels])
    miss = means.where(F.col("group") == OVERALL).select("variable", "n_missing")
    con = means.withColumn(
        "cell", F.format_string("%.1f (%.1f)", F.col("mean"), F.col("sd")))
    con = (con.groupBy("variable").pivot("group", labels).agg(F.first("cell"))
              .join(miss, "variable").withColumn("level", F.lit("")))
    first_level = F.row_number().over(Window.partitionBy("variable").orderBy("level"))
    pc = chi2(df, group, categorical, counts=counts).select("variable", "p_value")
    pt = welch_t(df, group, continuous, means=means).select("variable", "p_value")
    cat = (cat.join(pc, "variable", "left")
              .withColumn("p_value", F.when(first_level == 1, F.format_string("%.3f", "p_value")))
              .withColumn("n_missing", F.lit(None).cast("long")))
    con = con.join(pt, "variable", "left").withColumn("p_value", F.format_string("%.3f", "p_value"))
    cols = ["variable", "level", "n_missing", *labels, "p_value"]
    return cat.select(*cols).unionByName(con.select(*cols))
