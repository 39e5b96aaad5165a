from tabeval.functions.exprs import (  # noqa: F401
    MINUS_SIGN, SIGN_TOL, Z_975, clip01, classify, count_points_below, direction_sign, direction_txt,
    grid_point, md5_order, missing, p1, ratio, required,
)
