"""Variable selection with regression models.

- univariable logistic screen: one binomial model per candidate (with intercept), all
  candidates' Newton steps in one aggregation per iteration;
- multivariable logistic table: coefficients, odds ratios, Wald p-values
  (the reference fits this one without an intercept: ``fit_intercept=False``);
- LASSO: least squares with an L1 penalty on the 0/1 label (as the reference);
- the final logistic model on the selected variables, with its summary.

Every fit first writes the columns it needs to the shared folder, so the input is read
once however many iterations follow.  A missing label or feature stops the job by
default; ``on_missing="drop"`` leaves such rows out, and :func:`row_audit` counts them.
Only the fitted coefficients (one number per variable) reach the driver; p-values use
erfc(|z|/sqrt 2), which keeps the small ones that 1 - cdf rounds to 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.functions.exprs import missing, required
from tabeval.functions.tails import normal_two_sided
from tabeval.session import materialize


def _complete(columns: Sequence[str]):
    ok = F.lit(True)
    for c in columns:
        ok = ok & ~missing(c)
    return ok


def row_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows in, complete in ``columns``, and with a missing one."""
    ok = _complete(columns)
    return df.agg(F.count(F.lit(1)).alias("n_in"), F.count_if(ok).alias("n_used"), F.count_if(~ok).alias("n_refused"))


def design(df: DataFrame, label: str, features: Sequence[str], on_missing: str = "error") -> DataFrame:
    """Label and features as doubles, written once."""
    columns = [label, *features]
    if on_missing == "drop":
        df = df.where(_complete(columns))
    elif on_missing != "error":
        raise ValueError("on_missing must be 'error' or 'drop'")
    return materialize(df.select(*[required(c, c).alias(c) for c in columns]), "design")


def _glm(features: Sequence[str], label: str, fit_intercept: bool) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error"),
        GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_features", labelCol=label,
                                    fitIntercept=fit_intercept, maxIter=100, tol=1e-10,
                                    predictionCol="p")])


def _coef_rows(model: PipelineModel, features: Sequence[str], fit_intercept: bool) -> list[tuple]:
    glm = model.stages[-1]
    s = glm.summary
    se = list(s.coefficientStandardErrors)
    coefs = list(glm.coefficients)
    names = list(features)
    if fit_intercept:
        coefs, names = coefs + [glm.intercept], names + ["(intercept)"]
    rows = []
    for name, b, e in zip(names, coefs, se):
        z = b / e if e else float("nan")
        rows.append((name, float(b), float(e), float(z), normal_two_sided(z)))
    return rows


COEF_SCHEMA = "variable STRING, coefficient DOUBLE, std_error DOUBLE, z DOUBLE, p_value DOUBLE"


def fit_logistic(df: DataFrame, label: str, features: Sequence[str], fit_intercept: bool = True,
                 on_missing: str = "error") -> PipelineModel:
    """Binomial GLM (logit link); ``transform`` adds ``p`` = P(label = 1) and refuses missing features."""
    return _glm(features, label, fit_intercept).fit(design(df, label, features, on_missing))


def logit_table(df: DataFrame, label: str, features: Sequence[str], fit_intercept: bool = False,
                on_missing: str = "error") -> DataFrame:
    """(variable, coefficient, odds_ratio, std_error, z, p_value) of one multivariable fit."""
    m = fit_logistic(df, label, features, fit_intercept, on_missing)
    t = df.sparkSession.createDataFrame(_coef_rows(m, features, fit_intercept), COEF_SCHEMA)
    return t.select("variable", "coefficient", F.exp("coefficient").alias("odds_ratio"), "std_error", "z", "p_value")


def univariable_logit(df: DataFrame, label: str, features: Sequence[str], on_missing: str = "error",
                      tol: float = 1e-12, max_iter: int = 50) -> DataFrame:
    """(variable, coefficient, std_error, z, p_value): one model with intercept per candidate.

    Newton's method on standardised candidates.  One aggregation per iteration gives the
    score and the 2x2 information of every candidate, so the number of passes does not
    depend on the number of candidates."""
    features = list(features)
    d = design(df, label, features, on_missing)
    stats = d.agg(*[s for f in features for s in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))],
                  F.avg(label).alias("share")).first()
    centre = {f: (stats[f"m_{f}"] or 0.0, stats[f"s_{f}"] or 1.0) for f in features}
    share = min(max(stats["share"] or 0.5, 1e-6), 1 - 1e-6)
    beta = {f: (math.log(share / (1 - share)), 0.0) for f in features}
    error = dict.fromkeys(features, float("nan"))
    for _ in range(max_iter):
        sums = []
        for i, f in enumerate(features):
            x = (F.col(f) - F.lit(centre[f][0])) / F.lit(centre[f][1])
            p = 1.0 / (1.0 + F.exp(-(F.lit(beta[f][0]) + F.lit(beta[f][1]) * x)))
            r, w = F.col(label) - p, p * (1.0 - p)
            sums += [F.sum(v).alias(f"{n}{i}") for n, v in
                     (("g0_", r), ("g1_", r * x), ("h00_", w), ("h01_", w * x), ("h11_", w * x * x))]
        row = d.agg(*sums).first()
        moved = 0.0
        for i, f in enumerate(features):
            g0, g1, a, b, c = (row[f"{n}{i}"] or 0.0 for n in ("g0_", "g1_", "h00_", "h01_", "h11_"))
            det = a * c - b * b
            if det <= 1e-12 * a * c or not math.isfinite(det):
                continue   # a constant candidate, or one that separates the label
            error[f] = math.sqrt(a / det)
            s0, s1 = (c * g0 - b * g1) / det, (a * g1 - b * g0) / det
            beta[f] = (beta[f][0] + s0, beta[f][1] + s1)
            moved = max(moved, abs(s0), abs(s1))
        if moved < tol:
            break
    rows = []
    for f in features:
        b, e = beta[f][1] / centre[f][1], error[f] / centre[f][1]
        z = b / e if e else float("nan")
        rows.append((f, b, e, z, normal_two_sided(z)))
    return df.sparkSession.createDataFrame(rows, COEF_SCHEMA)


def significant(table: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Variables with p < alpha (one-column table)."""
    return table.where((F.col("p_value") < alpha) & (F.col("variable") != "(intercept)")).select("variable")


def logistic_summary(model: PipelineModel, features: Sequence[str], fit_intercept: bool = True) -> DataFrame:
    """Coefficient table plus AIC and deviance of a fitted logistic pipeline."""
    s = model.stages[-1].summary
    spark = _active_spark()
    t = spark.createDataFrame(_coef_rows(model, features, fit_intercept), COEF_SCHEMA)
    return t.withColumn("aic", F.lit(float(s.aic))).withColumn("deviance", F.lit(float(s.deviance)))


def lasso_select(df: DataFrame, label: str, features: Sequence[str], alpha: float = 0.1,
                 on_missing: str = "error") -> DataFrame:
    """(variable, coefficient, selected): least squares + alpha*|w|_1 on unscaled data,
    the objective of scikit-learn's Lasso; selected = coefficient != 0."""
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error"),
        LinearRegression(featuresCol="_features", labelCol=label, elasticNetParam=1.0, regParam=alpha,
                         standardization=False, fitIntercept=True, maxIter=1000, tol=1e-12)])
    m = pipe.fit(design(df, label, features, on_missing))
    coefs = list(m.stages[-1].coefficients)
    rows = [(f, float(c), bool(c != 0.0)) for f, c in zip(features, coefs)]
    return df.sparkSession.createDataFrame(rows, "variable STRING, coefficient DOUBLE, selected BOOLEAN")


def _active_spark():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()
