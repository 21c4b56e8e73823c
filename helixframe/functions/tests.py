"""Two-by-two tests, Hardy-Weinberg and p-value corrections as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def once(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b with NaN for 0 / 0 and infinities for x / 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    return ratio(a.cast("double") * d, b.cast("double") * c)


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Pearson's statistic of [[a, b], [c, d]] without continuity correction."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    return ratio((a + b + c + d) * (a * d - b * c) * (a * d - b * c), (a + b) * (c + d) * (a + c) * (b + d))


#: Rational approximations of erfc (FreeBSD msun, s_erf.c) for |x| under 0.84375, 1.25, 1/0.35 and beyond: numerator and denominator, lowest power first.
_ERF = (
    ((1.28379167095512558561e-01, -3.25042107247001499370e-01, -2.84817495755985104766e-02, -5.77027029648944159157e-03, -2.37630166566501626084e-05), (1.0, 3.97917223959155352819e-01, 6.50222499887672944485e-02, 5.08130628187576562776e-03, 1.32494738004321644526e-04, -3.96022827877536812320e-06)),
    ((-2.36211856075265944077e-03, 4.14856118683748331666e-01, -3.72207876035701323847e-01, 3.18346619901161753674e-01, -1.10894694282396677476e-01, 3.54783043256182359371e-02, -2.16637559486879084300e-03), (1.0, 1.06420880400844228286e-01, 5.40397917702171048937e-01, 7.18286544141962662868e-02, 1.26171219808761642112e-01, 1.36370839120290507362e-02, 1.19844998467991074170e-02)),
    ((-9.86494403484714822705e-03, -6.93858572707181764372e-01, -1.05586262253232909814e+01, -6.23753324503260060396e+01, -1.62396669462573470355e+02, -1.84605092906711035994e+02, -8.12874355063065934246e+01, -9.81432934416914548592e+00), (1.0, 1.96512716674392571292e+01, 1.37657754143519042600e+02, 4.34565877475229228821e+02, 6.45387271733267880336e+02, 4.29008140027567833386e+02, 1.08635005541779435134e+02, 6.57024977031928170135e+00, -6.04244152148580987438e-02)),
    ((-9.86494292470009928597e-03, -7.99283237680523006574e-01, -1.77579549177547519889e+01, -1.60636384855821916062e+02, -6.37566443368389627722e+02, -1.02509513161107724954e+03, -4.83519191608651397019e+02), (1.0, 3.03380607434824582924e+01, 3.25792512996573918826e+02, 1.53672958608443695994e+03, 3.19985821950859553908e+03, 2.55305040643316442583e+03, 4.74528541206955367215e+02, -2.24409524465858183362e+01)),
)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, to a relative error of 1e-13 or so."""

    def polynomial(c: tuple, z: Column) -> Column:
        out = F.lit(c[-1])
        for k in c[-2::-1]:
            out = out * z + k
        return out

    rational = lambda k, z: polynomial(_ERF[k][0], z) / polynomial(_ERF[k][1], z)
    near = 1 - (x + x * rational(0, x * x))
    middle = 1 - 8.45062911510467529297e-01 - rational(1, x - 1)
    far = lambda k: once(1 / (x * x), lambda z: F.exp(-x * x - 0.5625 + rational(k, z)) / x)
    return F.when(x < 0.84375, near).when(x < 1.25, middle).when(x < 1 / 0.35, far(2)).otherwise(far(3))


def chi_square_p(statistic: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom; NaN stays NaN."""
    return F.when(F.isnan(statistic), statistic).when(statistic == float("inf"), F.lit(0.0)).otherwise(once(F.sqrt(F.greatest(statistic, F.lit(0.0)) / 2), erfc))


#: ln n! of the first n, as a literal array.
_LOG_FACTORIALS = [math.log(math.factorial(n)) for n in range(171)]


def log_factorial(n: Column) -> Column:
    """ln n! for n >= 0: a table up to 170, Stirling's series with four terms beyond (error under 1e-14)."""
    x = (n + 1).cast("double")
    stirling = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    table = F.expr(f"array({', '.join(f'{v!r}D' for v in _LOG_FACTORIALS)})")
    return F.when(n < len(_LOG_FACTORIALS), F.get(table, n.cast("int"))).otherwise(stirling)


LESS, GREATER, TWO_SIDED = "LESS", "GREATER", "TWO_SIDED"


def fisher(a: Column, b: Column, c: Column, d: Column, mode: str = TWO_SIDED) -> Column:
    """Exact p-value: hypergeometric tables with the same margins, summed by mode."""

    def of(t: Column) -> Column:
        r1, r2, c1 = t["r1"], t["r2"], t["c1"]

        def logp(x: Column) -> Column:
            return t["fixed"] - log_factorial(x) - log_factorial(r1 - x) - log_factorial(c1 - x) - log_factorial(r2 - c1 + x)

        low, high = F.greatest(F.lit(0), c1 - r2), F.least(r1, c1)
        first, last = (low, t["a"]) if mode == LESS else (t["a"], high) if mode == GREATER else (low, high)
        if mode != TWO_SIDED:
            return F.least(F.lit(1.0), F.aggregate(F.transform(F.sequence(first, last), lambda x: F.exp(logp(x))), F.lit(0.0), lambda s, p: s + p))
        return once(logp(t["a"]), lambda seen: F.least(F.lit(1.0), F.aggregate(F.transform(F.sequence(first, last), logp), F.lit(0.0), lambda s, p: s + F.when(p <= seen + 1e-9, F.exp(p)).otherwise(0.0))))

    def margins(t: Column) -> Column:
        """The margins and what they add to each table's logarithm, once for all tables."""
        r1, r2, c1, c2 = t["a"] + t["b"], t["c"] + t["d"], t["a"] + t["c"], t["b"] + t["d"]
        fixed = log_factorial(r1) + log_factorial(r2) + log_factorial(c1) + log_factorial(c2) - log_factorial(r1 + r2)
        return F.struct(t["a"].alias("a"), r1.alias("r1"), r2.alias("r2"), c1.alias("c1"), fixed.alias("fixed"))

    return once(once(F.struct(*(x.cast("int").alias(k) for k, x in zip("abcd", (a, b, c, d), strict=True))), margins), of)


def hardy_weinberg(aa: Column, ab: Column, bb: Column) -> Column:
    """Exact p-value of Hardy-Weinberg equilibrium: all heterozygote counts as likely as, or less than, the seen one.

    Probabilities are relative to the log of the seen count, so nothing is lost for large counts.
    """

    def of(t: Column) -> Column:
        n = t["aa"] + t["ab"] + t["bb"]
        rare = 2 * F.least(t["aa"], t["bb"]) + t["ab"]
        common = 2 * n - rare

        def logp(h: Column) -> Column:
            return h * math.log(2) - log_factorial(h) - log_factorial(((rare - h) / 2).cast("int")) - log_factorial(((common - h) / 2).cast("int"))

        def tails(seen: Column) -> Column:
            every = F.transform(F.sequence(rare % 2, rare, F.lit(2)), logp)
            top = F.array_max(every)
            return once(F.struct(every.alias("e"), top.alias("m")), lambda z: F.aggregate(z["e"], F.lit(0.0), lambda s, p: s + F.when(p <= seen + 1e-9, F.exp(p - z["m"])).otherwise(0.0)) / F.aggregate(z["e"], F.lit(0.0), lambda s, p: s + F.exp(p - z["m"])))

        return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), once(logp(t["ab"]), tails)))

    return once(F.struct(*(x.cast("int").alias(k) for k, x in zip(("aa", "ab", "bb"), (aa, ab, bb), strict=True))), of)


METHODS = ("bonferroni", "bh", "by", "hochberg", "holm")


def adjust(df: DataFrame, p: str, method: str, out: str = "adjusted", ranges: int = 256) -> DataFrame:
    """Adds p-values corrected for multiple testing; null p-values stay null and do not count.

    Rows of equal p get equal corrections, so ranks and running extremes go over the distinct values with their
    counts. Those are dealt into ranges by quantiles, ranks and extremes run within a range, and one row for each
    range carries offsets: no task sees all values, and a value that many rows have is one row here.
    """
    valid = df.where(F.col(p).isNotNull())
    values = valid.groupBy(F.col(p).alias("_adj_p")).agg(F.count("*").alias("_adj_n"))
    cuts = values.select(F.percentile_approx("_adj_p", [k / ranges for k in range(1, ranges)], 50 * ranges)).first()[0] or [0.0]
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("_adj_p")))
    values = values.withColumn("_adj_range", at)
    sums = values.groupBy("_adj_range").agg(F.sum("_adj_n").alias("_adj_s"))
    every = Window.orderBy("_adj_range")
    sums = sums.select("_adj_range", (F.sum("_adj_s").over(every) - F.col("_adj_s")).alias("_adj_before"), F.sum("_adj_s").over(Window.partitionBy(F.lit(1))).cast("double").alias("_adj_m"))
    inside = Window.partitionBy("_adj_range").orderBy("_adj_p")
    rows = values.withColumn("_adj_in", F.sum("_adj_n").over(inside)).join(F.broadcast(sums), "_adj_range")  # one row for each range
    last = F.col("_adj_before") + F.col("_adj_in")  # the rank of the last of equal values
    v, m = F.col("_adj_p"), F.col("_adj_m")
    if method == "bonferroni":
        done = rows.withColumn(out, F.least(F.lit(1.0), v * m))
    else:
        if method == "by":
            size = valid.count()
            harmonic = sum(1 / i for i in range(1, min(size, 100_000) + 1)) + (math.log(size / 100_000) + 0.5 / size - 0.5 / 100_000 if size > 100_000 else 0.0)
        raw = {"bh": lambda: m / last * v, "by": lambda: harmonic * m / last * v, "hochberg": lambda: (m - last + 1) * v, "holm": lambda: (m - last + F.col("_adj_n")) * v}[method]()
        rows = rows.withColumn("_adj_raw", raw)
        up = method == "holm"  # Holm takes the largest so far, the others the smallest from here on
        best, first = (F.max, F.greatest) if up else (F.min, F.least)
        before, after = (Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)
        rows = rows.withColumn("_adj_own", best("_adj_raw").over(inside.rowsBetween(*(before if up else after))))
        beyond = every.rowsBetween(*((Window.unboundedPreceding, -1) if up else (1, Window.unboundedFollowing)))
        edge = rows.groupBy("_adj_range").agg(best("_adj_raw").alias("_adj_e")).select("_adj_range", best("_adj_e").over(beyond).alias("_adj_o"))
        done = rows.join(F.broadcast(edge), "_adj_range").withColumn(out, F.least(F.lit(1.0), first("_adj_own", F.coalesce("_adj_o", "_adj_own"))))
    done = done.select("_adj_p", out)
    return df.join(done, F.col(p) == F.col("_adj_p"), "left").select(*[F.col(f"`{c}`") for c in df.columns], out)
