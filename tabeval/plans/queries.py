"""Registered queries: each one a Spark plan over the testdata (``spark, sf_dir ->
DataFrame``) and, where SQL can say it, the DuckDB text that must give the same rows.

Every query reads whole tables; limits appear only where they are the feature
(a seeded sample, a top-k, the first rows of a table).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabeval.operators import evaluate as ev
from tabeval.plans import fixtures as fx
from tabeval.plans.report import rounded

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


SCORED = f"WITH scored AS ({fx.scored_sql()})"

# --------------------------------------------------------------------------- evaluation

CONFUSION_SQL = """
confusion AS (
  SELECT dataset, model,
         count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn,
         count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp,
         count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn,
         count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp
  FROM scored GROUP BY dataset, model)"""

METRICS_SQL = """
metrics AS (
  SELECT *, (tp + tn)::DOUBLE / nullif(tp + fn + tn + fp, 0) AS accuracy,
         tp::DOUBLE / nullif(tp + fp, 0) AS precision,
         tp::DOUBLE / nullif(tp + fn, 0) AS sensitivity,
         tn::DOUBLE / nullif(tn + fp, 0) AS specificity
  FROM confusion),
metrics2 AS (
  SELECT *, 2.0 * precision * sensitivity / nullif(precision + sensitivity, 0) AS f1 FROM metrics)"""

AUC_SQL = """
counts AS (
  SELECT dataset, model, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
  FROM scored GROUP BY dataset, model, p),
cum AS (
  SELECT *, coalesce(sum(pos) OVER (PARTITION BY dataset, model ORDER BY p DESC
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_before
  FROM counts),
auc AS (
  SELECT dataset, model, sum(pos) + sum(neg) AS n, sum(pos) AS n_pos, sum(neg) AS n_neg,
         sum(neg::HUGEINT * (2 * pos_before + pos))::DOUBLE
           / nullif(2.0 * sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0) AS auc
  FROM cum GROUP BY dataset, model),
auc_ci AS (
  SELECT *, auc - 1.959963984540054 * sqrt(auc * (1 - auc) / n) AS auc_lower,
            auc + 1.959963984540054 * sqrt(auc * (1 - auc) / n) AS auc_upper
  FROM auc)"""


def _scored(spark, sf_dir):
    return fx.scored(spark, sf_dir)


@register("confusion", f"{SCORED}, {CONFUSION_SQL} SELECT * FROM confusion")
def q_confusion(spark, sf_dir):
    return ev.confusion(_scored(spark, sf_dir))


@register("class_metrics", f"""{SCORED}, {CONFUSION_SQL}, {METRICS_SQL}
SELECT dataset, model, tn, fp, fn, tp, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(sensitivity, 6) AS sensitivity, round(f1, 6) AS f1, round(specificity, 6) AS specificity
FROM metrics2""")
def q_class_metrics(spark, sf_dir):
    return rounded(ev.class_metrics(ev.confusion(_scored(spark, sf_dir))))


@register("auc_ci", f"""{SCORED}, {AUC_SQL}
SELECT dataset, model, n, n_pos, n_neg, round(auc, 6) AS auc, round(auc_lower, 6) AS auc_lower,
       round(auc_upper, 6) AS auc_upper FROM auc_ci""")
def q_auc_ci(spark, sf_dir):
    return rounded(ev.auc_ci(ev.auc(_scored(spark, sf_dir))))


MODEL_TABLE_SQL = f"""{SCORED}, {CONFUSION_SQL}, {METRICS_SQL}, {AUC_SQL}
SELECT a.dataset, a.model, a.n, round(a.auc, 6) AS auc, round(a.auc_lower, 6) AS auc_lower,
       round(a.auc_upper, 6) AS auc_upper, round(m.accuracy, 6) AS accuracy, round(m.precision, 6) AS precision,
       round(m.sensitivity, 6) AS sensitivity, round(m.specificity, 6) AS specificity, round(m.f1, 6) AS f1,
       m.tn, m.fp, m.fn, m.tp
FROM auc_ci a JOIN metrics2 m USING (dataset, model)"""


@register("model_table", MODEL_TABLE_SQL)
def q_model_table(spark, sf_dir):
    return rounded(ev.model_table(_scored(spark, sf_dir)))


@register("roc_curve", f"""{SCORED},
counts AS (
  SELECT dataset, model, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
  FROM scored GROUP BY dataset, model, p),
cum AS (
  SELECT *,
    sum(pos) OVER w AS tps, sum(neg) OVER w AS fps,
    sum(pos) OVER (PARTITION BY dataset, model) AS P_, sum(neg) OVER (PARTITION BY dataset, model) AS N_,
    row_number() OVER (PARTITION BY dataset, model ORDER BY p DESC) AS rn,
    lead(pos) OVER (PARTITION BY dataset, model ORDER BY p DESC) AS pos_next,
    lead(neg) OVER (PARTITION BY dataset, model ORDER BY p DESC) AS neg_next
  FROM counts
  WINDOW w AS (PARTITION BY dataset, model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pts AS (
  SELECT dataset, model, p AS threshold, fps::DOUBLE / nullif(N_, 0) AS fpr, tps::DOUBLE / nullif(P_, 0) AS tpr
  FROM cum WHERE rn = 1 OR pos_next IS NULL OR pos_next <> pos OR neg_next <> neg
  UNION ALL
  SELECT dataset, model, NULL::DOUBLE, CASE WHEN sum(neg) > 0 THEN 0.0 END, CASE WHEN sum(pos) > 0 THEN 0.0 END
  FROM counts GROUP BY dataset, model)
SELECT dataset, model, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM pts""")
def q_roc_curve(spark, sf_dir):
    return rounded(ev.roc_curve(_scored(spark, sf_dir)))


@register("calibration", f"""{SCORED},
binned AS (
  SELECT *, 1 + least(greatest(
      len(list_filter(list_transform(range(0, 11), lambda k: CASE WHEN k = 10 THEN 1.0::DOUBLE
                                                             ELSE k * (1.0::DOUBLE / 10) END),
                      lambda e: e < p)) - 1, 0), 9) AS bin
  FROM scored)
SELECT dataset, model, bin::INTEGER AS bin, round(avg(p), 6) AS prob_pred, round(avg(y::DOUBLE), 6) AS prob_true,
       count(*) AS n
FROM binned GROUP BY dataset, model, bin""")
def q_calibration(spark, sf_dir):
    return rounded(ev.calibration(_scored(spark, sf_dir), n_bins=10))


@register("decision_curve", f"""{SCORED},
th AS (
  SELECT k, CASE WHEN k = 99 THEN 1.0::DOUBLE ELSE k * ((1.0::DOUBLE - 0.01::DOUBLE) / 99) + 0.01::DOUBLE END AS t
  FROM range(0, 100) r(k)),
tot AS (SELECT dataset, model, count(*) FILTER (WHERE y = 1) AS P_, count(*) FILTER (WHERE y = 0) AS N_,
               count(*) AS n FROM scored GROUP BY dataset, model),
nb AS (
  SELECT s.dataset, s.model, th.t,
         count(*) FILTER (WHERE s.y = 1 AND s.p > th.t) AS tp,
         count(*) FILTER (WHERE s.y = 0 AND s.p > th.t) AS fp
  FROM scored s, th GROUP BY s.dataset, s.model, th.t)
SELECT nb.dataset, nb.model, round(nb.t, 6) AS threshold,
       round(nb.tp::DOUBLE / tot.n - nb.fp::DOUBLE / tot.n * (nb.t / nullif(1 - nb.t, 0)), 6) AS net_benefit,
       round(tot.P_::DOUBLE / tot.n - tot.N_::DOUBLE / tot.n * (nb.t / nullif(1 - nb.t, 0)), 6) AS treat_all,
       0.0::DOUBLE AS treat_none
FROM nb JOIN tot USING (dataset, model)""")
def q_decision_curve(spark, sf_dir):
    return rounded(ev.decision_curve(_scored(spark, sf_dir)))


@register("model_table_docs", MODEL_TABLE_SQL.replace(SCORED, f"WITH scored AS ({fx.scored_docs_sql()})", 1))
def q_model_table_docs(spark, sf_dir):
    """The comparison table over a second, join-fed source: labels x documents."""
    return rounded(ev.model_table(fx.scored_docs(spark, sf_dir)))
