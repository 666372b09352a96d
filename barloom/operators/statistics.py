"""Returns, least squares and factor cleaning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def returns(df: DataFrame, price_col: str = "close", period: int = 1, method: str = "simple", return_col: str = "return", keys: tuple[str, ...] = (), order: tuple[str, ...] = ("date",)) -> DataFrame:
    """Simple or log return over `period` rows of a series; null where the earlier price is 0 or missing."""
    x = F.col(price_col).cast("double")
    y = F.lag(x, period).over(Window.partitionBy(*keys).orderBy(*order))
    if method not in ("simple", "log"):
        raise ValueError(f"unknown method: {method}")
    out = F.when(y != 0, (x - y) / y) if method == "simple" else F.when((y > 0) & (x > 0), F.log(F.when(y > 0, x / y)))
    return df.withColumn(return_col, out)


def normal_equations(x_cols: list[str], y_col: str) -> list[Column]:
    """Aggregates n, sums and cross products of (1, x..., y) over rows without nulls; order as least_squares() reads it."""
    names = [*x_cols, y_col]
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull()
    x = [F.when(ok, F.col(c).cast("double")) for c in names]
    pairs = [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i + 1)]
    return [F.count(F.when(ok, 1)), *(F.sum(v) for v in x), *pairs]


def least_squares(sums: list[float]) -> tuple[np.ndarray, float, np.ndarray, int] | None:
    """(coefficients with the intercept first, R2, standard errors, rows) from normal_equations(); None if singular."""
    n = int(sums[0])
    k = int((-3 + math.sqrt(9 + 8 * (len(sums) - 1))) / 2)
    if n <= k - 1:
        return None
    m = np.zeros((k + 1, k + 1))
    m[0, 0] = n
    m[0, 1:] = m[1:, 0] = sums[1 : k + 1]
    at = k + 1
    for i in range(k):
        for j in range(i + 1):
            m[i + 1, j + 1] = m[j + 1, i + 1] = sums[at]
            at += 1
    means = m[0, 1:] / n
    centred = m[1:, 1:] - n * np.outer(means, means)
    sxx, sxy, syy = centred[:-1, :-1], centred[:-1, -1], centred[-1, -1]
    try:
        inverse = np.linalg.inv(sxx)
    except np.linalg.LinAlgError:
        return None
    b = inverse @ sxy
    rss = max(0.0, float(syy - b @ sxy))
    r2 = 1 - rss / syy if syy > 0 else 0.0
    dof = n - k
    s2 = rss / dof if dof > 0 else float("nan")
    errors = np.sqrt(np.concatenate(([s2 * (1 / n + means[:-1] @ inverse @ means[:-1])], s2 * np.diag(inverse))))
    return np.concatenate(([means[-1] - b @ means[:-1]], b)), r2, errors, n


def linear(df: DataFrame, x_cols: list[str], y_col: str, pred_col: str = "pred", resid_col: str = "resid", return_stats: bool = False):
    """Least squares with an intercept over all rows: one pass of sums, solved on the driver (a matrix of the columns'
    number), and predictions as an expression."""
    fit = least_squares([float(v or 0) for v in df.agg(*normal_equations(x_cols, y_col)).first()])
    b = fit[0] if fit else np.full(len(x_cols) + 1, np.nan)
    pred = F.lit(float(b[0]))
    for c, k in zip(x_cols, b[1:], strict=True):
        pred = pred + F.lit(float(k)) * F.col(c).cast("double")
    out = df.withColumn(pred_col, pred).withColumn(resid_col, F.col(y_col).cast("double") - pred)
    return (out, ([float(k) for k in b], float(fit[1]) if fit else float("nan"))) if return_stats else out


def clean(df: DataFrame, col: str, winsorize: str | None = None, winsorize_n: float | None = None, neutralize_market_cap: bool = False, cap_col: str | None = None, neutralize_industry: bool = False, industry_col: str | None = None, standardize: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `{col}_cleaned`: winsorized (mad: median +- 3 x 1.4826 MAD, sigma, percentile), then regressed on log cap,
    then less the industry mean, then z-scored; each within the groups `by` (all rows as one if empty).

    A step is one pre-aggregated statistic per group and a join of the groups' few values; rows are not gathered."""
    out = f"{col}_cleaned"
    df = df.withColumn(out, F.col(col).cast("double"))
    x = F.col(out)
    if winsorize == "mad":
        df = _with(df, by, __m=F.percentile(out, F.lit(0.5)))
        df = _with(df, by, __d=F.percentile(F.abs(F.col(out) - F.col("__m")), F.lit(0.5)))
        width = 3.0 * 1.4826 * F.col("__d")
        df = df.withColumn(out, F.when(x.isNotNull(), F.greatest(F.least(x, F.col("__m") + width), F.col("__m") - width))).drop("__m", "__d")
    elif winsorize == "sigma":
        n = 3.0 if winsorize_n is None else winsorize_n
        df = _with(df, by, __m=F.avg(out), __d=F.stddev_samp(out))
        df = df.withColumn(out, F.when(x.isNotNull(), F.greatest(F.least(x, F.col("__m") + n * F.col("__d")), F.col("__m") - n * F.col("__d")))).drop("__m", "__d")
    elif winsorize == "percentile":
        n = (1.0 if winsorize_n is None else winsorize_n) / 100
        df = _with(df, by, __m=F.percentile(out, F.lit(n)), __d=F.percentile(out, F.lit(1 - n)))
        df = df.withColumn(out, F.when(x.isNotNull(), F.greatest(F.least(x, F.col("__d")), F.col("__m")))).drop("__m", "__d")
    elif winsorize:
        raise ValueError(f"unknown winsorize: {winsorize}")
    if neutralize_market_cap:
        if not cap_col:
            raise ValueError("cap_col is needed")
        cap = F.when(F.col(cap_col) > 0, F.log(F.when(F.col(cap_col) > 0, F.col(cap_col).cast("double"))))
        df = df.withColumn("__cap", cap)
        df = _with(df, by, __b=F.regr_slope(F.col(out), F.col("__cap")), __a=F.regr_intercept(F.col(out), F.col("__cap")))
        df = df.withColumn(out, x - F.coalesce(F.col("__a") + F.col("__b") * F.col("__cap"), F.lit(0.0))).drop("__cap", "__a", "__b")
    if neutralize_industry:
        if not industry_col:
            raise ValueError("industry_col is needed")
        df = _with(df, (*by, industry_col), __m=F.avg(out)).withColumn(out, x - F.col("__m")).drop("__m")
    if standardize:
        df = _with(df, by, __m=F.avg(out), __d=F.stddev_samp(out)).withColumn(out, F.when(F.col("__d") != 0, (x - F.col("__m")) / F.col("__d"))).drop("__m", "__d")
    return df


def _with(df: DataFrame, by: tuple[str, ...], **stats: Column) -> DataFrame:
    """df with aggregates of each row's group."""
    named = [v.alias(k) for k, v in stats.items()]
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*named)))  # one row
    groups = df.groupBy(*by).agg(*named)
    keys = [f"__k{n}" for n in range(len(by))]
    groups = groups.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), *stats)
    on = F.lit(True)
    for c, k in zip(by, keys, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    return df.join(groups, on).drop(*keys)


def student_p(t: float | None, dof: float) -> float | None:
    """Two-sided p-value of a t statistic, by the regularised incomplete beta function."""
    if t is None or math.isnan(t) or dof <= 0:
        return None
    if math.isinf(t):
        return 0.0
    x = dof / (dof + t * t)
    return _beta(dof / 2, 0.5, x)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out
