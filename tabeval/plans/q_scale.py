"""Variants with deeper cuts than the testdata needs, checked by the same oracles on
the whole tables: two nested range cuts for ordered sums (the default at these sizes
is one), and salted rank joins with a low bound for what counts as a hot value.
"""

from __future__ import annotations

from tabeval.operators import consistency as cs
from tabeval.operators import evaluate as ev
from tabeval.operators import profile as pr
from tabeval.plans import fixtures as fx
from tabeval.plans import q_explain, q_profile  # noqa: F401  (their oracles are reused here)
from tabeval.plans.queries import ORACLES, register
from tabeval.plans.report import rounded
from tabeval.sources.io import testdata_table

LEVELS = 2


@register("auc_ci_range_cut", ORACLES["auc_ci"])
def q_auc_ci_range_cut(spark, sf_dir):
    return rounded(ev.auc_ci(ev.auc(fx.scored(spark, sf_dir), levels=LEVELS)))


@register("roc_curve_range_cut", ORACLES["roc_curve"])
def q_roc_curve_range_cut(spark, sf_dir):
    return rounded(ev.roc_curve(fx.scored(spark, sf_dir), levels=LEVELS))


@register("quantiles_range_cut", ORACLES["quantiles"])
def q_quantiles_range_cut(spark, sf_dir):
    return rounded(pr.quantiles(testdata_table(spark, sf_dir, "events"), ["value", "user_id"],
                                (0.1, 0.25, 0.5, 0.75, 0.9), levels=LEVELS))


@register("spearman_range_cut", ORACLES["spearman"])
def q_spearman_range_cut(spark, sf_dir):
    return rounded(cs.spearman(q_explain.events_shap(spark, sf_dir), ["model", "feature"], "value", "phi",
                               levels=LEVELS))


@register("spearman_salted", ORACLES["spearman"])
def q_spearman_salted(spark, sf_dir):
    return rounded(cs.spearman(q_explain.events_shap(spark, sf_dir), ["model", "feature"], "value", "phi", hot_rows=20))
