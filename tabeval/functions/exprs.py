"""Column expressions shared by the operators.  All built-in, all codegen-able."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
MINUS_SIGN = "−"          # direction text for a negative sign (U+2212, not ASCII '-')
Z_975 = 1.959963984540054      # standard normal 97.5 % quantile, for 95 % intervals
SIGN_TOL = 0.05                # |r| below this is "no direction"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    """A float parameter as a DOUBLE literal; a Column (e.g. a scalar subquery) as is."""
    return v if isinstance(v, Column) else F.lit(float(v))


def ratio(num, den) -> Column:
    """num / den, NULL when den is 0 (ANSI mode would raise)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def missing(c) -> Column:
    """NULL or NaN."""
    x = col(c).cast("double")
    return x.isNull() | F.isnan(x)


def required(c, name: str) -> Column:
    """The value as DOUBLE; a NULL or NaN stops the job and says which column it is."""
    return F.when(missing(c), F.raise_error(F.lit(f"missing value in {name}"))).otherwise(col(c).cast("double"))


def direction_sign(r, tol: float = SIGN_TOL) -> Column:
    """Three-way sign with a dead zone: NULL/NaN -> 0, |r| < tol -> 0, else sign(r)."""
    r = col(r)
    return (F.when(r.isNull() | F.isnan(r), F.lit(0))
            .when(F.abs(r) < tol, F.lit(0))
            .when(r > 0, F.lit(1))
            .otherwise(F.lit(-1))).cast("int")


def direction_txt(s) -> Column:
    """Sign to text: '+', U+2212, or '0'."""
    s = col(s)
    return F.when(s > 0, F.lit("+")).when(s < 0, F.lit(MINUS_SIGN)).otherwise(F.lit("0"))


def clip01(c) -> Column:
    return F.least(F.greatest(col(c), F.lit(0.0)), F.lit(1.0))


def classify(p, cut: float = 0.5) -> Column:
    """Probability to class with the reference's `>= cut` rule."""
    return (col(p) >= F.lit(cut)).cast("int")


def p1(probability_col: str = "probability") -> Column:
    """Probability of class 1 from a pyspark.ml probability vector."""
    return vector_to_array(F.col(probability_col)).getItem(1)


def grid_point(k, start: float, step: float, n: int, stop: float | None = None) -> Column:
    """k-th point of numpy ``linspace``: ``k*step + start``, the last one pinned to ``stop``.

    Written the way numpy computes it so that points compare bit-for-bit equal.
    """
    k = col(k)
    v = k.cast("double") * _lit(step) + _lit(start)
    if stop is not None:
        v = F.when(k == F.lit(n - 1), _lit(stop)).otherwise(v)
    return v


def count_points_below(x, start: float, step: float, n: int, stop: float | None = None,
                       strict: bool = True) -> Column:
    """Number of grid points ``g_k`` (k = 0..n-1) with ``g_k < x`` (or ``<=`` if not strict).

    O(1) per row: an arithmetic guess, then an exact check of the two neighbours
    against the grid points as numpy computes them.  Equals the brute-force count
    (tested), but keeps whole-stage codegen instead of a per-row loop over n points.
    NULL x gives NULL.
    """
    x = col(x)
    c0 = F.least(F.greatest(F.ceil(F.try_divide(x - _lit(start), _lit(step))), F.lit(0)), F.lit(n)).cast("int")

    def below(k):  # grid point k lies below x
        g = grid_point(k, start, step, n, stop)
        return (g < x) if strict else (g <= x)

    # the guess is off by at most one; at most one of the two corrections fires
    down = F.when((c0 > 0) & ~below(c0 - 1), F.lit(1)).otherwise(F.lit(0))
    up = F.when((c0 < n) & below(c0), F.lit(1)).otherwise(F.lit(0))
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(c0 - down + up)


def md5_order(seed, id_col) -> Column:
    """Seeded, engine-independent pseudo-random order key: md5('<seed>:<id>')."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), col(id_col).cast("string")))
