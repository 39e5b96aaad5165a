"""DuckDB texts for the fitted models and their tails, built from the definitions.

``newton`` writes Newton's method for a logistic model as a recursive query: each step
aggregates the score and the information over all rows and solves the small system by
Cholesky factors.  ``lasso`` writes coordinate descent on the Gram matrix.  The tails are
power series with positive terms over ``lgamma``.
"""

from __future__ import annotations

from collections.abc import Sequence


def p_normal(z: str) -> str:
    """Two-sided tail of the standard normal: 1 - 2 pdf(z) sum z^(2k+1) / (2k+1)!!"""
    a = f"abs({z})"
    term = f"exp((2*k+1) * ln({a}) - lgamma(2*k+2) + k * ln(2.0) + lgamma(k+1) - {a} * {a} / 2)"
    return (f"CASE WHEN {z} = 0 THEN 1.0 WHEN {a} > 8 THEN 0.0 ELSE greatest(0.0, 1 - sqrt(2 / pi()) * "
            f"list_sum(list_transform(range(0, 300), lambda k: {term}))) END")


def p_chi2(x: str, dof: str) -> str:
    """Upper tail of chi-square: 1 - x^a e^-x sum x^k / Gamma(a+k+1) at half the values."""
    a, h = f"({dof} / 2.0)", f"({x} / 2.0)"
    return (f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 2000), "
            f"lambda k: exp(({a} + k) * ln({h}) - {h} - lgamma({a} + k + 1))))) END")


def p_student(t: str, df: str) -> str:
    """Two-sided tail of t: 1 - I_x(1/2, df/2), x = t^2 / (df + t^2), by its power series."""
    x, b = f"({t} * {t} / ({df} + {t} * {t}))", f"({df} / 2.0)"
    term = (f"exp((0.5 + k) * ln({x}) + {b} * ln(1 - {x}) + lgamma(0.5 + {b} + k) - lgamma({b}) - lgamma(1.5 + k))")
    return (f"CASE WHEN {t} = 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 2000), lambda k: {term}))) END")


def newton(name: str, rows: str, label: str, features: Sequence[str], intercept: bool, steps: int = 30) -> str:
    """CTEs ``<name>_b`` (b0.., one row) and ``<name>`` (i, b, se) of a logistic fit over ``rows``;
    the intercept comes last.  Begin the query with WITH RECURSIVE."""
    x = [*features, "1.0"] if intercept else list(features)
    k, n = len(x), name
    cols = ", ".join(f"b{i}" for i in range(k))
    eta = " + ".join(f"b{i} * x{i}" for i in range(k))
    data = f"{n}_d AS (SELECT {label}::DOUBLE AS y, " + ", ".join(f"({e})::DOUBLE AS x{i}" for i, e in enumerate(x)) + \
        f" FROM {rows})"
    grad = ", ".join(f"sum((y - p) * x{i}) AS g{i}" for i in range(k))
    info = ", ".join(f"sum(p * (1 - p) * x{i} * x{j}) AS h{i}_{j}" for i in range(k) for j in range(i + 1))

    def sums(source: str, where: str) -> str:
        return (f"(SELECT it, {cols}, {grad}, {info} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p "
                f"FROM {source}, {n}_d {where}) GROUP BY it, {cols})")

    def factored(q: str) -> str:   # l<i>_<j>: lower Cholesky factor, column by column
        for j in range(k):
            done = "".join(f" - l{j}_{m} * l{j}_{m}" for m in range(j))
            q = f"(SELECT *, sqrt(h{j}_{j}{done}) AS l{j}_{j} FROM {q})"
            below = [f"(h{i}_{j}" + "".join(f" - l{i}_{m} * l{j}_{m}" for m in range(j)) + f") / l{j}_{j} AS l{i}_{j}"
                     for i in range(j + 1, k)]
            if below:
                q = f"(SELECT *, {', '.join(below)} FROM {q})"
        return q

    def solved(q: str) -> str:
        for i in range(k):
            done = "".join(f" - l{i}_{m} * z{m}" for m in range(i))
            q = f"(SELECT *, (g{i}{done}) / l{i}_{i} AS z{i} FROM {q})"
        for i in reversed(range(k)):
            done = "".join(f" - l{m}_{i} * s{m}" for m in range(i + 1, k))
            q = f"(SELECT *, (z{i}{done}) / l{i}_{i} AS s{i} FROM {q})"
        return q

    def inverse_diagonal(q: str) -> str:   # of the information: columns of the inverse factor
        for c in range(k):
            for i in range(c, k):
                done = "".join(f" - l{i}_{m} * w{c}_{m}" for m in range(c, i))
                q = f"(SELECT *, ({1.0 if i == c else 0.0}{done}) / l{i}_{i} AS w{c}_{i} FROM {q})"
        return q

    step = ", ".join(f"b{i} + s{i}" for i in range(k))
    start = ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(k))
    out = " UNION ALL ".join(
        f"SELECT {i} AS i, b{i} AS b, sqrt({' + '.join(f'w{i}_{m} * w{i}_{m}' for m in range(i, k))}) AS se FROM {n}_v"
        for i in range(k))
    return f"""{data},
{n}_s AS (SELECT 0 AS it, {start} UNION ALL
  SELECT it + 1, {step} FROM {solved(factored(sums(f'{n}_s', f'WHERE it < {steps}')))}),
{n}_b AS (SELECT * FROM {n}_s WHERE it = {steps}),
{n}_v AS (SELECT * FROM {inverse_diagonal(factored(sums(f'{n}_b', '')))}),
{n} AS ({out})"""


def lasso(rows: str, label: str, features: Sequence[str], alpha: float, rounds: int = 400) -> str:
    """CTE ``lasso`` (w0..): coordinate descent for least squares / 2n + alpha |w|_1 with intercept."""
    k = len(features)
    avg = ", ".join(f"avg(({f})::DOUBLE) AS m{i}" for i, f in enumerate(features))
    cov = ", ".join(f"covar_pop(({features[i]})::DOUBLE, ({features[j]})::DOUBLE) AS c{i}_{j}"
                    for i in range(k) for j in range(i + 1))
    tie = ", ".join(f"covar_pop(({f})::DOUBLE, ({label})::DOUBLE) AS t{i}" for i, f in enumerate(features))
    q = f"(SELECT * FROM lasso_s, lasso_g WHERE it < {rounds})"
    for i in range(k):
        rest = "".join(f" - c{max(i, j)}_{min(i, j)} * {'v' if j < i else 'w'}{j}" for j in range(k) if j != i)
        r = f"(t{i}{rest})"
        q = f"(SELECT *, sign({r}) * greatest(abs({r}) - {alpha}, 0) / c{i}_{i} AS v{i} FROM {q})"
    start = ", ".join(f"0.0::DOUBLE AS w{i}" for i in range(k))
    return f"""lasso_g AS (SELECT {avg}, {cov}, {tie} FROM {rows}),
lasso_s AS (SELECT 0 AS it, {start} UNION ALL SELECT it + 1, {', '.join(f'v{i}' for i in range(k))} FROM {q}),
lasso AS (SELECT * FROM lasso_s WHERE it = {rounds})"""
