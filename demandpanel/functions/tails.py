"""Tail probabilities as Column expressions: series and continued fractions folded over the steps they need."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .fixed import UNIT_ROOT_LARGE, UNIT_ROOT_MAX, UNIT_ROOT_MIN, UNIT_ROOT_SMALL, UNIT_ROOT_SPLIT

_TINY = 1e-300
#: Samples up to this size get the exact two-sample tail, as the usual statistics libraries do.
EXACT_ROWS = 10_000
#: Scaled distances beyond it have a tail below 1e-31, the same to all digits in both forms.
FAR = 6.0


def _known(out: Column, *values: Column) -> Column:
    """NULL unless every value is a number."""
    ok = F.lit(True)
    for v in values:
        ok = ok & v.isNotNull() & ~F.isnan(v)
    return F.when(ok, out)


def _let(values: dict[str, Column], body) -> Column:
    """``body`` of named values, each worked out once."""
    held = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(held, lambda v: body(*[v[k] for k in values])), F.lit(0))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series eight places on, taken back."""
    z = x + 8
    back = x
    for i in range(1, 8):
        back = back * (x + i)
    inverse = 1 / (z * z)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / z
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(back)


def _lentz(steps: Column, first: Column, term, c: float = 1.0) -> Column:
    """Value of a continued fraction by Lentz's method; ``term(m)`` is the (numerator, denominator) of step m."""
    start = F.struct(F.lit(c).alias("c"), (1.0 / first).alias("d"), (1.0 / first).alias("h"))

    def step(acc: Column, m: Column) -> Column:
        numerator, denominator = term(m.cast("double"))
        # _TINY changes no sum but one that is zero.
        return _let({"n": numerator, "b": denominator}, lambda n, b: _let(
            {"c": b + n / acc["c"] + _TINY, "d": 1.0 / (b + n * acc["d"] + _TINY)},
            lambda c, d: F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))))

    return F.aggregate(F.sequence(F.lit(1), steps.cast("int")), start, step, lambda acc: acc["h"])


def incomplete_beta(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function of x, with y = 1 - x given apart so that neither loses digits."""
    def below(x: Column, y: Column, a: Column, b: Column) -> Column:
        def term(j: Column):
            m = F.ceil(j / 2)
            top = F.when(j % 2 == 1, m * (b - m)).otherwise(-(a + m) * (a + b + m))
            return top * x / ((a + j) * (a + j + 1)), F.lit(1.0)

        # The fraction needs about as many steps as the root of the larger parameter.
        steps = F.least(F.lit(10_000.0), 60 + 8 * F.sqrt(F.greatest(a, b)))
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(y)) / a
        return front * _lentz(steps, 1 - (a + b) * x / (a + 1) + _TINY, term)

    def inner(x: Column, y: Column, a: Column, b: Column) -> Column:
        flip = x >= (a + 1) / (a + b + 2)
        swapped = {"x": F.when(flip, y).otherwise(x), "y": F.when(flip, x).otherwise(y), "a": F.when(flip, b).otherwise(a), "b": F.when(flip, a).otherwise(b)}
        part = _let(swapped, below)
        return F.when(x <= 0, 0.0).when(y <= 0, 1.0).otherwise(_let({"p": part, "f": flip}, lambda p, f: F.when(f, 1.0 - p).otherwise(p)))

    return _let({"x": x, "y": y, "a": a, "b": b}, inner)


def upper_gamma(a: float, x: Column) -> Column:
    """Regularised upper incomplete gamma function of x."""
    def inner(x: Column) -> Column:
        front = F.exp(a * F.ln(x) - x - math.lgamma(a))
        series = F.aggregate(
            F.sequence(F.lit(1), F.lit(80)), F.struct(F.lit(1.0 / a).alias("t"), F.lit(1.0 / a).alias("s")),
            lambda acc, i: F.struct((acc["t"] * x / (a + i)).alias("t"), (acc["s"] + acc["t"] * x / (a + i)).alias("s")), lambda acc: acc["s"])
        fraction = _lentz(F.lit(200), x + 1 - a, lambda m: (-m * (m - a), x + 2 * m + 1 - a), 1 / _TINY)
        return F.when(x <= 0, 1.0).when(x < a + 1, 1.0 - front * series).otherwise(front * fraction)

    return _let({"x": x}, inner)


def t_p(t: Column, dof: Column) -> Column:
    """Two-sided tail of Student's t; NULL without degrees of freedom."""
    def inner(t: Column, dof: Column) -> Column:
        tail = incomplete_beta(dof / (dof + t * t), t * t / (dof + t * t), dof / 2, F.lit(0.5))
        return _known(F.when(dof > 0, F.when(F.abs(t) == float("inf"), 0.0).otherwise(tail)), t, dof)

    return _let({"t": t.cast("double"), "dof": dof.cast("double")}, inner)


def normal_p(z: Column) -> Column:
    """Two-sided tail of the normal distribution."""
    return _known(upper_gamma(0.5, z * z / 2), z)


def normal_cdf(z: Column) -> Column:
    return _known(_let({"z": z, "h": upper_gamma(0.5, z * z / 2) / 2}, lambda z, h: F.when(z < 0, h).otherwise(1 - h)), z)


def chi2_p(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return _known(upper_gamma(0.5, x / 2), x)


def ks_limit(d: Column, n_a: Column, n_b: Column) -> Column:
    """Two-sample Kolmogorov–Smirnov tail from the limiting series, in the form that converges fast."""
    z = F.sqrt(n_a * n_b / (n_a + n_b)) * d

    def total(last: int, term) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(last)), F.lit(0.0), lambda acc, k: acc + term(k))

    small = 1 - math.sqrt(2 * math.pi) / z * total(20, lambda k: F.exp(-F.pow(2.0 * k - 1, F.lit(2)) * math.pi ** 2 / (8 * z * z)))
    large = 2 * total(100, lambda k: (2 * (k % 2) - 1) * F.exp(-2.0 * k * k * z * z))
    p = F.when(z < 1e-9, 1.0).when(z < 1.18, small).otherwise(large)
    return _known(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)), d, n_a, n_b)


def ks_exact(d: Column, n_a: Column, n_b: Column) -> Column:
    """Two-sample Kolmogorov–Smirnov tail of continuous samples, exactly.

    Merging both samples in order is a random walk over a lattice of n_a by n_b steps. The
    probability of every point that the walk reaches with its distance always below d is
    carried on, one diagonal of the lattice after the other; only the band below d is kept.
    """
    a, b = n_a.cast("long"), n_b.cast("long")
    m, n = F.least(a, b), F.greatest(a, b)
    most = F.round(d * m * n).cast("long") - 1  # largest |i n - j m| that is still below d

    def band(s: Column) -> tuple[Column, Column]:
        low = F.ceil((s * m - most).cast("double") / (m + n)).cast("int")
        high = F.floor((s * m + most).cast("double") / (m + n)).cast("int")
        return F.greatest(F.lit(0), low, (s - n).cast("int")), F.least(high, m.cast("int"), s.cast("int"))

    start = F.struct(F.lit(0).alias("low"), F.array(F.lit(1.0)).alias("p"))

    def step(acc: Column, s: Column) -> Column:
        low, high = band(s)
        left = (m + n - s + 1).cast("double")

        def point(i: Column) -> Column:
            at = i - acc["low"]
            above = F.when(at >= 1, F.get(acc["p"], at - 1))
            beside = F.when(at >= 0, F.get(acc["p"], at))
            return (F.coalesce(above, F.lit(0.0)) * (m - i + 1) + F.coalesce(beside, F.lit(0.0)) * (n - s + i + 1)) / left

        points = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), point)).otherwise(F.array().cast("array<double>"))
        return F.struct(low.alias("low"), points.alias("p"))

    inside = F.aggregate(F.sequence(F.lit(1).cast("long"), m + n), start, step, lambda acc: F.coalesce(F.get(acc["p"], F.lit(0)), F.lit(0.0)))
    return F.when(most < 0, 1.0).otherwise(F.least(F.greatest(1 - inside, F.lit(0.0)), F.lit(1.0)))


def ks_p(d: Column, n_a: Column, n_b: Column) -> Column:
    """Two-sample Kolmogorov–Smirnov tail: exact up to EXACT_ROWS rows a sample, from the limiting series beyond."""
    def inner(d: Column, n_a: Column, n_b: Column) -> Column:
        near = (F.greatest(n_a, n_b) <= EXACT_ROWS) & (F.sqrt(n_a * n_b / (n_a + n_b)) * d <= FAR)
        return _known(F.when((n_a > 0) & (n_b > 0), F.when(near, ks_exact(d, n_a, n_b)).otherwise(ks_limit(d, n_a, n_b))), d, n_a, n_b)

    return _let({"d": d.cast("double"), "a": n_a.cast("double"), "b": n_b.cast("double")}, inner)


def unit_root_p(stat: Column) -> Column:
    """P-value of the unit-root statistic (constant, no trend) from the response surface."""
    def surface(values) -> Column:
        out = F.lit(0.0)
        for c in reversed(values):
            out = out * stat + c
        return out

    p = F.when(stat > UNIT_ROOT_MAX, 1.0).when(stat < UNIT_ROOT_MIN, 0.0)
    return _known(p.otherwise(normal_cdf(F.when(stat <= UNIT_ROOT_SPLIT, surface(UNIT_ROOT_SMALL)).otherwise(surface(UNIT_ROOT_LARGE)))), stat)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation: t with n − 2 degrees of freedom."""
    def inner(r: Column, dof: Column) -> Column:
        t = r * F.sqrt(dof / F.nullif(F.lit(1.0) - r * r, F.lit(0.0)))
        return F.when((F.abs(r) >= 1) & (dof > 0), F.lit(0.0)).when(dof > 0, t_p(t, dof))

    return _let({"r": r, "dof": (n - 2).cast("double")}, inner)
