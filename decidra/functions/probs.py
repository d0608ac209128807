"""Probability functions over `array<double>` columns.

Ties in an argmax go to the first option.  Logarithms are floored at 1e-12.  An empty
denominator gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import dot, let, one_hot, running, total

FLOOR = 1e-12


def log_floor(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(FLOOR)))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Stable softmax; temperatures below 0.001 count as 0.001."""
    t = F.greatest(temperature if isinstance(temperature, Column) else F.lit(float(temperature)), F.lit(1e-3))

    def scaled(z: Column) -> Column:
        return let(F.transform(z, lambda x: F.exp((x - F.array_max(z)) / t)), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))

    return let(logits, scaled)


def log_softmax(logits: Column) -> Column:
    def shifted(z: Column) -> Column:
        return let(F.array_max(z) + F.log(total(F.transform(z, lambda x: F.exp(x - F.array_max(z))))), lambda n: F.transform(z, lambda x: x - n))

    return let(logits, shifted)


def normalized(weights: Column) -> Column:
    """Weights over their sum; all equal where the sum is 0."""
    return let(weights, lambda w: let(total(w), lambda s: F.when(s > 0, F.transform(w, lambda x: x / s)).otherwise(F.transform(w, lambda x: F.lit(1.0) / F.size(w)))))


def yes_no_readout(pairs: Column, qtype: Column) -> Column:
    """Probabilities from per-option structs (yes, no) of logits.

    Choice and score: softmax of yes - no.  Noul: softmax of the only pair, as [false, true].
    """
    odds = softmax(F.transform(pairs, lambda p: p["yes"] - p["no"]))
    return F.when(qtype == "noul", softmax(F.array(pairs[0]["no"], pairs[0]["yes"]))).otherwise(odds)


def entropy(p: Column) -> Column:
    return total(F.transform(p, lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)))


def confidence(p: Column) -> Column:
    """1 - entropy / ln k, within [0, 1]; 1 for fewer than two options."""
    raw = F.lit(1.0) - entropy(p) / F.log(F.size(p))
    return F.when(F.size(p) < 2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def binary_confidence(p: Column) -> Column:
    return F.greatest(p[1], F.lit(1.0) - p[1])


def top_gap(p: Column) -> Column:
    """Largest, gap to the second largest (0 stands in for a missing one)."""
    ranked = F.sort_array(p, asc=False)
    return let(ranked, lambda r: F.struct(r[0].alias("top"), (r[0] - F.coalesce(F.get(r, F.lit(1)), F.lit(0.0))).alias("gap")))


def temperature_bucket(qtype: Column, options: Column) -> Column:
    size = F.when(options <= 2, "2").when(options <= 5, "3-5").when(options <= 10, "6-10").otherwise("11+")
    return F.concat(qtype, F.lit(":"), size)


def clamped_temperature(t: Column, low: float = 0.5, high: float = 5.0) -> Column:
    """Within [low, high]; 1 for nulls, NaN and infinities."""
    usable = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    return F.when(usable, F.least(F.lit(high), F.greatest(F.lit(low), t))).otherwise(1.0)


def reheated(logits: Column, served: Column | float, wanted: Column | float) -> Column:
    """Probabilities at another temperature, from logits that were served over `served`."""
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (served, wanted))
    return softmax(F.transform(logits, lambda z: z * a / b))


def brier(p: Column, target: Column) -> Column:
    """Sum over the options of squared differences."""
    return total(F.zip_with(p, target, lambda x, y: (x - y) * (x - y)))


def hard_brier(p: Column, gold: Column) -> Column:
    return brier(p, one_hot(gold, F.size(p)))


def nll(p: Column, gold: Column) -> Column:
    return -log_floor(F.get(p, gold))


def cross_entropy(p: Column, target: Column) -> Column:
    return -total(F.zip_with(p, target, lambda x, t: t * log_floor(x)))


def kl(p: Column, target: Column) -> Column:
    """Cross entropy less the target's entropy; 0 ln 0 is 0."""
    return cross_entropy(p, target) - entropy(target)


def expected_level(p: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)


def rps(p: Column, target: Column) -> Column:
    """Ranked probability score: sum over all boundaries but the last of squared CDF gaps."""
    gaps = F.zip_with(running(p), running(target), lambda x, y: (x - y) * (x - y))
    return let(gaps, lambda g: total(F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0)))))


def normalized_rps(p: Column, target: Column) -> Column:
    return F.try_divide(rps(p, target), (F.size(p) - 1).cast("double"))


def reward(p: Column, target: Column, qtype: Column, spherical: float = 0.5, ranked: float = 1.0, floor: float = -9.21) -> Column:
    """Log score (floored) + weighted spherical score - weighted RPS / (k - 1) for scores."""
    log_score = total(F.zip_with(p, target, lambda x, t: t * F.greatest(log_floor(x), F.lit(floor))))
    round_ = dot(p, target) / F.greatest(F.sqrt(dot(p, p)), F.lit(1e-9))
    levels = F.greatest(F.size(p), F.lit(2)) - 1
    cdf = let(F.zip_with(running(p), running(target), lambda x, y: (x - y) * (x - y)), total)
    return log_score + F.lit(spherical) * round_ - F.when(qtype == "score", F.lit(ranked) * cdf / levels).otherwise(0.0)


def is_distribution(p: Column, tolerance: Column | float = 1e-6) -> Column:
    """All finite, none negative, sum within the tolerance of 1."""
    t = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    finite = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    return F.coalesce(finite & (F.abs(total(p) - 1.0) <= t), F.lit(False))


def rounding_tolerance(options: Column, digits: int) -> Column:
    """Tolerance of a reference distribution that was rounded to so many digits."""
    return F.greatest(F.lit(1e-6), options * F.lit(0.5 * 10.0**-digits) + F.lit(1e-12))
