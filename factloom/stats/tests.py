"""Statistical tests from group aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.amounts import normal_cdf, normal_quantile
from ..operators.order import cumulative_share, join_null_safe, value_positions


# fixed values: coefficients of the Lanczos approximation of the gamma function (g = 7)
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z of 0.5 and above."""
    x = z - 1
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (x + k)
    return 0.5 * F.log(F.lit(2 * math.pi)) + (x + 0.5) * F.log(x + 7.5) - (x + 7.5) + F.log(series)


def incomplete_beta(a: Column, b: Column, x: Column, steps: int = 600) -> Column:
    """Regularised incomplete beta function by its continued fraction; a and b of 0.5 and above, x in [0, 1]."""
    def fraction(a, b, x):
        def step(d, c, h, term):
            d, c = 1 + term * d, 1 + term / c
            d = 1 / F.when(F.abs(d) < 1e-300, F.lit(1e-300)).otherwise(d)
            c = F.when(F.abs(c) < 1e-300, F.lit(1e-300)).otherwise(c)
            return d, c, h * d * c

        def both(s, m):
            d, c, h = step(s["d"], s["c"], s["h"], m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
            once = F.struct(d.alias("d"), c.alias("c"), h.alias("h"))
            return F.transform(F.array(once), lambda t: F.struct(*[v.alias(n) for v, n in zip(step(
                t["d"], t["c"], t["h"], -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))), "dch")]))[0]

        first = 1 / (1 - (a + b) * x / (a + 1))
        start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, both, lambda s: s["h"])

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    return (F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), front * fraction(a, b, x) / a)
            .otherwise(1 - front * fraction(b, a, 1 - x) / b))


def welch_t(df: DataFrame, value: str, flag: str) -> DataFrame:
    """Two-sample t-test with unequal variances for a boolean flag (true minus false).

    One row: means, counts, t, degrees of freedom and a two-sided p from the t distribution.
    """
    def side(cond):
        x = F.when(cond, F.col(value))
        return F.count(x), F.avg(x), F.var_samp(x)
    (n1, m1, v1), (n0, m0, v0) = side(F.col(flag)), side(~F.col(flag))
    base = df.agg(n1.alias("n_true"), n0.alias("n_false"), m1.alias("mean_true"), m0.alias("mean_false"),
                  v1.alias("_v1"), v0.alias("_v0"))
    s1, s0 = F.col("_v1") / F.col("n_true"), F.col("_v0") / F.col("n_false")
    out = base.withColumn("t", (F.col("mean_true") - F.col("mean_false")) / F.sqrt(s1 + s0)).withColumn(
        "df", F.pow(s1 + s0, F.lit(2.0)) / (s1 * s1 / (F.col("n_true") - 1) + s0 * s0 / (F.col("n_false") - 1)))
    p = incomplete_beta(F.greatest(F.col("df") / 2, F.lit(0.5)), F.lit(0.5), F.col("df") / (F.col("df") + F.col("t") * F.col("t")))
    return out.withColumn("p", p).drop("_v1", "_v0")


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square (with continuity correction for 2 x 2) and bias-corrected Cramer's V: one row.

    Works on the counts of (a, b); empty cells enter through the margins.
    """
    # both filters are explicit, so that all uses of the counts share one shuffle
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy(a).agg(F.sum("o").alias("r"))
    cols = cells.groupBy(b).agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o").cast("double")).scalar()
    joined = cells.join(rows, a).join(cols, b).withColumn("_n", total)
    expected = F.col("r") * F.col("c") / F.col("_n")
    sums = joined.agg(
        F.max("_n").alias("n"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("k"),
        F.sum(F.col("o") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("_q"),
        F.max(F.abs(F.col("o") - expected)).alias("_d"))
    plain = F.col("n") * (F.col("_q") - 1)
    shrink = F.when((F.col("r") == 2) & (F.col("k") == 2) & (F.col("_d") > 0),
                    F.pow((F.col("_d") - F.least(F.lit(0.5), F.col("_d"))) / F.col("_d"), F.lit(2.0))).otherwise(F.lit(1.0))
    phi2 = F.greatest(F.lit(0.0), F.col("chi2") / F.col("n")
                      - (F.col("k") - 1) * (F.col("r") - 1) / (F.col("n") - 1))
    r_c = F.col("r") - F.pow(F.col("r") - 1, F.lit(2.0)) / (F.col("n") - 1)
    k_c = F.col("k") - F.pow(F.col("k") - 1, F.lit(2.0)) / (F.col("n") - 1)
    return (sums.withColumn("chi2", plain * shrink)
            .withColumn("cramers_v", F.sqrt(F.try_divide(phi2, F.least(r_c - 1, k_c - 1))))
            .select(F.col("n").cast("bigint").alias("n"), "r", "k", "chi2", "cramers_v"))


def best_distribution(df: DataFrame, cols) -> DataFrame:
    """Kolmogorov-Smirnov distance of every column to four fitted distributions.

    Result: column, distribution ('norm', 'powerlaw', 'expon', 'uniform'), d, p, best. The empirical
    distribution is computed in value buckets, see ``cumulative_share``.
    """
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "column", "x").where(F.col("x").isNotNull())
    fits = long.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"),
                                      F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.col("hi") - F.col("lo")
    inner = join_null_safe(long, fits, ["column"])
    # shape of the power law given its range
    shapes = (inner.where(F.col("x") > F.col("lo")).groupBy("column")
              .agg(F.try_divide(-F.count("x"), F.sum(F.ln((F.col("x") - F.col("lo")) / width))).alias("shape")))
    steps = join_null_safe(join_null_safe(cumulative_share(long, "x", ["column"]), fits, ["column"]), shapes, ["column"])
    x = F.col("value")
    unit = (x - F.col("lo")) / width
    dists = {
        "norm": normal_cdf((x - F.col("mean")) / F.col("sd")),
        "powerlaw": F.pow(unit, F.col("shape")),
        "expon": 1 - F.exp(-(x - F.col("lo")) / (F.col("mean") - F.col("lo"))),
        "uniform": unit}
    gaps = steps.where((width > 0) & (F.col("sd") > 0)).groupBy("column").agg(F.max("total").alias("n"), *[
        F.max(F.greatest(F.abs(cdf - F.col("share_below")), F.abs(F.col("share_upto") - cdf))).alias(name)
        for name, cdf in dists.items()])
    out = gaps.unpivot(["column", "n"], list(dists), "distribution", "d")
    lam = (F.sqrt("n") + 0.12 + 0.11 / F.sqrt("n")) * F.col("d")
    tail = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 21)), F.lit(0.0))
    p = F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))
    first = F.row_number().over(Window.partitionBy("column").orderBy("d", "distribution"))
    return out.withColumn("p", p).withColumn("best", first == 1).drop("n")


def normality(df: DataFrame, vec: str, level: float = 0.05) -> DataFrame:
    """Jarque-Bera test per vector dimension: dim, n, skewness, kurtosis, jb, p, gaussian.

    Stands in for Shapiro-Wilk, which needs all ordered values of a dimension at once.
    """
    stats = (df.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim")
             .agg(F.count("x").alias("n"), F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis")))
    jb = F.col("n") / 6 * (F.pow("skewness", F.lit(2.0)) + F.pow("kurtosis", F.lit(2.0)) / 4)
    return (stats.withColumn("jb", jb).withColumn("p", F.exp(-F.col("jb") / 2))
            .withColumn("gaussian", F.col("p") > level))


# fixed values: Royston's polynomials (1992, 1995) in 1 / sqrt(n), in n and in log n, lowest power first
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
NEXT_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_MEAN, SMALL_SD = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN, LARGE_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def _polynomial(coefs, x) -> Column:
    out = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * x + F.lit(c)
    return out


def shapiro_wilk(df: DataFrame, vec: str, level: float = 0.05) -> DataFrame:
    """Shapiro-Wilk test per vector dimension: dim, n, w, p, gaussian.

    The weights of the ordered values come from the normal scores of their positions, which are exact ranks over value buckets;
    equal values take the mean score of their positions. All sums are partial aggregates, so no dimension is gathered.
    Weights and p follow Royston's approximation, which is meant for 3 to 5000 values; above, it is
    carried on, W is still right to its approximation, and p should be read as an order of magnitude. Below 3 values and for
    constant dimensions w and p are NULL. NULL values are left out.
    """
    long = df.select(F.posexplode(vec).alias("dim", "x")).select("dim", F.col("x").cast("double").alias("x"))
    at = value_positions(long, "x", ["dim"])
    # a run of equal values is cut, so that no row stands for more than a bounded number of positions
    cut = at.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(10_000).cast("long"))))
    spots = F.sequence(F.col("before") + F.col("_from") + 1, F.col("before") + F.least(F.col("n"), F.col("_from") + 10_000))
    each = cut.select("dim", "value", F.col("total").alias("n"), F.explode(spots).alias("i"))
    n, i = F.col("n"), F.col("i")
    each = each.withColumn("m", normal_quantile((i - 0.375) / (n + 0.25)))

    def spot(k, c):
        return F.max(F.when(i == k, F.col(c)))

    sums = each.groupBy("dim").agg(
        F.max("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("_mm"), F.sum(F.col("m") * F.col("value")).alias("_mx"),
        (F.var_pop("value") * F.count("value")).alias("_ss"), spot(n, "m").alias("_m1"), spot(n - 1, "m").alias("_m2"),
        (spot(n, "value") - spot(F.lit(1), "value")).alias("_d1"), (spot(n - 1, "value") - spot(F.lit(2), "value")).alias("_d2"))
    u, mm, m1, m2, d1, d2 = 1 / F.sqrt("n"), F.col("_mm"), F.col("_m1"), F.col("_m2"), F.col("_d1"), F.col("_d2")
    last = F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(m1 / F.sqrt(mm) + _polynomial(LAST_WEIGHT, u))
    after = F.when(n > 5, m2 / F.sqrt(mm) + _polynomial(NEXT_WEIGHT, u)).otherwise(0.0)
    sums = sums.where("n >= 3").withColumn("_a1", last).withColumn("_a2", after)
    two = F.when(n > 5, 1.0).otherwise(0.0)  # with up to 5 values only the last weight is corrected
    a1, a2 = F.col("_a1"), F.col("_a2")
    scale = (mm - 2 * m1 * m1 - 2 * two * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
    middle = F.when(n == 3, 0.0).otherwise((F.col("_mx") - m1 * d1 - two * m2 * d2) / F.sqrt(scale))
    total = middle + a1 * d1 + a2 * d2
    sums = sums.withColumn("w", F.when(F.col("_ss") > 0, F.least(F.lit(1.0), total * total / F.col("_ss"))))
    w, log_n, real = F.col("w"), F.log(n.cast("double")), n.cast("double")
    few = n < 12
    x = F.when(few, -F.log(0.459 * real - 2.273 - F.log(1 - w))).otherwise(F.log(1 - w))
    mean = F.when(few, _polynomial(SMALL_MEAN, real)).otherwise(_polynomial(LARGE_MEAN, log_n))
    sd = F.exp(F.when(few, _polynomial(SMALL_SD, real)).otherwise(_polynomial(LARGE_SD, log_n)))
    three = F.lit(6 / math.pi) * (F.asin(F.sqrt(w)) - F.asin(F.sqrt(F.lit(0.75))))
    p = F.when(w >= 1, 1.0).when(n == 3, F.greatest(F.lit(0.0), three)).otherwise(1 - normal_cdf((x - mean) / sd))
    return sums.withColumn("p", p).select("dim", "n", "w", "p", (F.col("p") > level).alias("gaussian"))


def yeo_johnson(col, lam) -> Column:
    """Yeo-Johnson power transform of a column with power ``lam`` (number or column)."""
    x = F.col(col) if isinstance(col, str) else col
    lam = F.lit(float(lam)) if isinstance(lam, (int, float)) else lam
    up = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def fit_yeo_johnson(df: DataFrame, col: str, by=(), low: float = -2.0, high: float = 4.0, step: float = 0.1) -> DataFrame:
    """(group, lambda): the power with the largest log-likelihood on a grid, then on a grid ten times finer.

    Every pass is one aggregate with a variance per grid point.
    """
    by = list(by)
    x = F.col(col).cast("double")
    skew = F.sum(F.when(x >= 0, F.log1p(x)).otherwise(-F.log1p(-x)))

    def best(table: DataFrame, lambdas) -> DataFrame:
        # each power is constant inside a group, so max() only carries it through the aggregate
        entries = [F.struct((-F.count(x) / 2 * F.ln(F.var_pop(yeo_johnson(x, lam))) + (F.max(lam) - 1) * skew).alias("llf"),
                            F.max(lam).alias("lam")) for lam in lambdas]
        return table.groupBy(*by).agg(F.array_max(F.array(*entries))["lam"].alias("lambda"))

    n = round((high - low) / step)
    rows = df.where(F.col(col).isNotNull())
    coarse = best(rows, [F.lit(round(low + i * step, 6)) for i in range(n + 1)])
    near = join_null_safe(rows, coarse, by) if by else rows.withColumn("lambda", coarse.select("lambda").scalar())
    return best(near, [F.round(F.col("lambda") + F.lit(k * step / 10), 6) for k in range(-9, 10)])
