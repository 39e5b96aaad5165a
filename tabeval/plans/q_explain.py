"""Registered explanation and consistency queries.

The fixture: three fixed models over three event features, explained with exact
Shapley values for every event against a 200-row seeded background sample.  The
oracle evaluates the definition by brute force: events x coalitions x background.
"""

from __future__ import annotations

import re


from tabeval.operators import consistency as cs
from tabeval.operators import explain as xp
from tabeval.operators.split import sample_n
from tabeval.plans import fixtures as fx
from tabeval.plans.queries import register
from tabeval.plans.report import rounded

SEED = 2025
N_BACKGROUND = 200
FEATURES = [n for n, _ in fx.EVENT_FEATURES]
WATERFALL_ROW = 5


def events_shap(spark, sf_dir):
    ev = fx.events_features(spark, sf_dir)
    bg = sample_n(ev, N_BACKGROUND, SEED, "row_id")
    models = [xp.SqlModel(n, e) for n, e in fx.EVENT_MODELS]
    return xp.kernel_shap(ev, bg, FEATURES, models, mode="exact")


def _shap_sql() -> str:
    m = len(FEATURES)
    coal = ", ".join(f"({c}, " + ", ".join("true" if c >> j & 1 else "false" for j in range(m)) + ")" for c in range(2 ** m))
    mcols = ", ".join(f"m{j}" for j in range(m))

    def weight(s: int) -> str:   # s! (m-s-1)! / m!
        return f"(factorial(({s})::INT) * factorial(({m - 1} - ({s}))::INT))::DOUBLE / factorial({m})::DOUBLE"

    def phi_of(j: int, f: str) -> str:   # the map's terms in coalition order
        terms = " + ".join(f"{weight(bin(c).count('1') - 1)} * v{c}" if c >> j & 1 else
                           f"-({weight(bin(c).count('1'))}) * v{c}" for c in range(2 ** m))
        return f"SELECT model, row_id, '{f}' AS feature, {terms} AS phi, ev.{f} AS value FROM wide JOIN ev USING (row_id)"

    pat = re.compile(r"\b(" + "|".join(FEATURES) + r")\b")
    v_parts = []
    for name, expr in fx.EVENT_MODELS:
        body = pat.sub(lambda m: f"(CASE WHEN c.m{FEATURES.index(m.group(1))} THEN e.{m.group(1)} "
                                 f"ELSE b.{m.group(1)} END)", expr)
        # summed in background order, as Spark's aggregate() does: bit-equal results
        v_parts.append(f"SELECT '{name}' AS model, e.row_id, c.cid, "
                       f"list_reduce(list_transform(bg.rows, lambda b: {body}), lambda a, x: a + x) / {N_BACKGROUND} AS v "
                       f"FROM ev e, coal c, bg")
    return f"""
ev AS ({fx.events_features_sql()}),
bg AS (SELECT list({{{', '.join(f"'{f}': {f}" for f in FEATURES)}}} ORDER BY bpos) AS rows FROM (
  SELECT *, row_number() OVER (ORDER BY md5(concat('{SEED}', ':', row_id::VARCHAR)), row_id) AS bpos
  FROM ev QUALIFY bpos <= {N_BACKGROUND})),
coal AS (SELECT * FROM (VALUES {coal}) t(cid, {mcols})),
v AS ({' UNION ALL '.join(v_parts)}),
wide AS (SELECT model, row_id, {', '.join(f'max(v) FILTER (cid = {c}) AS v{c}' for c in range(2 ** m))} FROM v GROUP BY 1, 2),
phi AS ({' UNION ALL '.join(phi_of(j, f) for j, f in enumerate(FEATURES))}),
base AS (SELECT model, row_id, v AS base FROM v WHERE cid = 0),
shap AS (SELECT phi.model, phi.row_id, phi.feature, phi.value, phi.phi, base.base
         FROM phi JOIN base USING (model, row_id))"""


SHAP = "WITH " + _shap_sql()

SPEARMAN_SQL = """,
rk AS (SELECT model, feature, value, phi,
         rank() OVER (PARTITION BY model, feature ORDER BY value)
           + (count(*) OVER (PARTITION BY model, feature, value) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY model, feature ORDER BY phi)
           + (count(*) OVER (PARTITION BY model, feature, phi) - 1) / 2.0 AS ry
       FROM shap WHERE value IS NOT NULL AND phi IS NOT NULL),
sp AS (SELECT model, feature, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS spearman_r,
              count(*) AS n FROM rk GROUP BY 1, 2),
dir AS (SELECT model, feature, spearman_r,
          (CASE WHEN spearman_r IS NULL OR isnan(spearman_r) THEN 0 WHEN abs(spearman_r) < 0.05 THEN 0
                WHEN spearman_r > 0 THEN 1 ELSE -1 END)::INTEGER AS sign FROM sp),
ma AS (SELECT model, feature, avg(abs(phi)) AS mean_abs_shap FROM shap GROUP BY 1, 2),
nrm AS (SELECT model, feature, CASE WHEN max(mean_abs_shap) OVER (PARTITION BY model) > 0
                                    THEN mean_abs_shap / max(mean_abs_shap) OVER (PARTITION BY model)
                                    ELSE 0.0 END AS I_norm FROM ma),
ovr AS (SELECT feature, avg(I_norm) AS I_norm FROM nrm GROUP BY 1),
agr AS (SELECT feature, avg(spearman_r) AS mean_r, abs(avg(spearman_r)) AS S_abs, avg(s) AS S_overall,
               coalesce(CASE WHEN avg(s) > 0 THEN count(*) FILTER (WHERE s = 1)
                             WHEN avg(s) < 0 THEN count(*) FILTER (WHERE s = -1) END / count(*), 0.0) AS Q_agree,
               count(*)::INTEGER AS n_models
        FROM (SELECT feature, spearman_r, CASE WHEN abs(spearman_r) < 0.05 THEN 0
                                               WHEN spearman_r > 0 THEN 1 ELSE -1 END AS s
              FROM dir WHERE spearman_r IS NOT NULL AND NOT isnan(spearman_r)) GROUP BY 1),
cons AS (SELECT a.feature, a.mean_r, a.S_abs, a.S_overall, a.Q_agree, a.n_models, o.I_norm,
                a.S_abs * a.Q_agree AS S_abs_times_Q,
                CASE WHEN a.S_overall > 0 THEN '+' WHEN a.S_overall < 0 THEN '−' ELSE '0' END AS direction_txt
         FROM agr a LEFT JOIN ovr o USING (feature))"""

R6 = "round({0}, 6) AS {0}"


def _r(*cols):
    return ", ".join(R6.format(c) for c in cols)


@register("shap_exact", f"{SHAP} SELECT model, row_id, feature, {_r('value', 'phi', 'base')} FROM shap")
def q_shap_exact(spark, sf_dir):
    return rounded(events_shap(spark, sf_dir))


@register("shap_importance", f"""{SHAP}, ma AS (SELECT model, feature, avg(abs(phi)) AS mean_abs_shap FROM shap GROUP BY 1, 2)
SELECT model, feature, {_r('mean_abs_shap')}, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean_abs_shap DESC, feature) AS rank FROM ma)
WHERE rank <= 15""")
def q_shap_importance(spark, sf_dir):
    return rounded(xp.shap_importance(events_shap(spark, sf_dir), 15))


@register("shap_points", f"""{SHAP}, ma AS (SELECT model, feature, avg(abs(phi)) AS mean_abs_shap FROM shap GROUP BY 1, 2),
imp AS (SELECT model, feature, row_number() OVER (PARTITION BY model ORDER BY mean_abs_shap DESC, feature) AS rank
        FROM ma)
SELECT s.model, s.feature, i.rank, s.row_id, {_r('value', 'phi')} FROM shap s JOIN imp i USING (model, feature)
WHERE i.rank <= 2""")
def q_shap_points(spark, sf_dir):
    return rounded(xp.shap_points(events_shap(spark, sf_dir), 2))


@register("shap_dependence", f"""{SHAP}
SELECT model, row_id, round(max(CASE WHEN feature = 'amount' THEN value END), 6) AS value,
       round(max(CASE WHEN feature = 'amount' THEN phi END), 6) AS phi,
       round(max(CASE WHEN feature = 'hr' THEN value END), 6) AS color_value
FROM shap WHERE feature IN ('amount', 'hr') GROUP BY model, row_id""")
def q_shap_dependence(spark, sf_dir):
    return rounded(xp.shap_dependence(events_shap(spark, sf_dir), "amount", "hr"))


@register("shap_force", f"""{SHAP}
SELECT model, row_id, round(any_value(base), 6) AS base,
       round(sum(CASE WHEN phi > 0 THEN phi ELSE 0 END), 6) AS push_up,
       round(sum(CASE WHEN phi < 0 THEN phi ELSE 0 END), 6) AS push_down,
       round(any_value(base) + sum(phi), 6) AS fx
FROM shap GROUP BY model, row_id""")
def q_shap_force(spark, sf_dir):
    return rounded(xp.shap_force(events_shap(spark, sf_dir)))


@register("shap_waterfall", f"""{SHAP},
one AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(phi) DESC, feature) AS rk,
               count(*) OVER (PARTITION BY model) AS n FROM shap WHERE row_id = {WATERFALL_ROW}),
items AS (SELECT model, rk, feature, value, phi, base FROM one WHERE rk < 2 OR n <= 2
          UNION ALL
          SELECT model, 2, count(*)::VARCHAR || ' other features', NULL, sum(phi), any_value(base)
          FROM one WHERE rk >= 2 AND n > 2 GROUP BY model),
cum AS (SELECT *, base + coalesce(sum(phi) OVER (PARTITION BY model ORDER BY rk DESC
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM items)
SELECT model, rk::INTEGER AS step, feature, {_r('value', 'phi', 'start')}, round(start + phi, 6) AS "end" FROM cum""")
def q_shap_waterfall(spark, sf_dir):
    return rounded(xp.shap_waterfall(events_shap(spark, sf_dir), WATERFALL_ROW, 2))


@register("spearman", f"{SHAP}{SPEARMAN_SQL} SELECT model, feature, {_r('spearman_r')}, n FROM sp")
def q_spearman(spark, sf_dir):
    return rounded(cs.spearman(events_shap(spark, sf_dir), ["model", "feature"], "value", "phi"))


@register("shap_direction", f"{SHAP}{SPEARMAN_SQL} SELECT model, feature, {_r('spearman_r')}, sign FROM dir")
def q_shap_direction(spark, sf_dir):
    return rounded(cs.shap_direction(events_shap(spark, sf_dir)))


@register("shap_mean_abs", f"{SHAP}{SPEARMAN_SQL} SELECT model, feature, {_r('mean_abs_shap')} FROM ma")
def q_shap_mean_abs(spark, sf_dir):
    return rounded(cs.shap_mean_abs(events_shap(spark, sf_dir)))


@register("norm_importance", f"{SHAP}{SPEARMAN_SQL} SELECT model, feature, {_r('I_norm')} FROM nrm")
def q_norm_importance(spark, sf_dir):
    return rounded(cs.normalise_importance(cs.shap_mean_abs(events_shap(spark, sf_dir))))


@register("overall_importance", f"{SHAP}{SPEARMAN_SQL} SELECT feature, {_r('I_norm')} FROM ovr")
def q_overall_importance(spark, sf_dir):
    return rounded(cs.overall_importance(cs.normalise_importance(cs.shap_mean_abs(events_shap(spark, sf_dir)))))


@register("direction_agreement", f"""{SHAP}{SPEARMAN_SQL}
SELECT feature, {_r('mean_r', 'S_abs', 'S_overall', 'Q_agree')}, n_models FROM agr""")
def q_direction_agreement(spark, sf_dir):
    return rounded(cs.direction_agreement(cs.shap_direction(events_shap(spark, sf_dir))))


@register("direction_vote", f"""{SHAP}{SPEARMAN_SQL}
SELECT feature, round(abs(avg(sign)), 6) AS S_abs, round(avg(sign), 6) AS S_overall,
       round(coalesce(CASE WHEN avg(sign) > 0 THEN count(*) FILTER (WHERE sign = 1)
                           WHEN avg(sign) < 0 THEN count(*) FILTER (WHERE sign = -1) END / count(*), 0.0), 6)
         AS Q_agree,
       count(*)::INTEGER AS n_models
FROM dir GROUP BY feature""")
def q_direction_vote(spark, sf_dir):
    return rounded(cs.direction_agreement(cs.shap_direction(events_shap(spark, sf_dir)), method="vote"))


@register("consistency", f"""{SHAP}{SPEARMAN_SQL}
SELECT feature, {_r('mean_r', 'S_abs', 'S_overall', 'Q_agree')}, n_models, {_r('I_norm', 'S_abs_times_Q')},
       direction_txt FROM cons""")
def q_consistency(spark, sf_dir):
    return rounded(cs.consistency(events_shap(spark, sf_dir)))


@register("radar_frame", f"""{SHAP}{SPEARMAN_SQL},
top AS (SELECT *, row_number() OVER (ORDER BY I_norm DESC NULLS LAST, feature) - 1 AS position FROM cons)
SELECT position, feature, feature || ' (' || direction_txt || ')' AS label,
       round(2.0 * pi() * position / (SELECT least(count(*), 2) FROM cons), 6) AS angle,
       round(least(greatest(I_norm, 0.0), 1.0), 6) AS bar, round(least(greatest(S_abs, 0.0), 1.0), 6) AS line
FROM top WHERE position < 2""")
def q_radar_frame(spark, sf_dir):
    return rounded(cs.radar_frame(cs.consistency(events_shap(spark, sf_dir)), top_k=2, use_metric="S_abs"))
