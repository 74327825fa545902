"""Column functions over vectors of state probabilities, changes and p-values."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: State order; ties and arrays follow it.
STAGES = ("w", "n1", "n2", "n3", "r")
PROBABILITIES = tuple(f"prob_{s}" for s in STAGES)
#: Fixed: names under which a state may arrive.
STAGE_ALIASES = {"w": "w", "wake": "w", "n1": "n1", "s1": "n1", "n2": "n2", "s2": "n2", "n3": "n3", "s3": "n3", "r": "r", "rem": "r"}


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def entropy(columns: list[str], normalized: bool = False) -> Column:
    """Shannon entropy in nats, over ln(k) if normalized; NULL if any probability isn't finite."""
    terms = [F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c))).otherwise(0.0) for c in columns]
    total = -reduce(lambda a, b: a + b, terms)
    return F.when(_all([_finite(F.col(c)) for c in columns]), total / math.log(len(columns)) if normalized else total)


def argmax_label(columns: list[str], labels: list[str]) -> Column:
    """Label of the largest value, the first of equals; NULL and NaN never win, all missing is NULL."""
    clean = [F.when(~F.isnan(F.col(c)), F.col(c)) for c in columns]
    top = F.greatest(*clean)
    return reduce(lambda e, x: e.when(x[0] == top, F.lit(x[1])), zip(clean, labels, strict=True), F.when(F.lit(False), F.lit("")))


def valid_probabilities(columns: list[str], tolerance: float = 1e-5) -> Column:
    """True if every value lies in [0, 1] and they add up to 1 within the tolerance."""
    in_range = _all([F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False)) for c in columns])
    return in_range & (F.abs(reduce(lambda a, b: a + b, [F.col(c) for c in columns]) - 1.0) <= tolerance)


def probability_columns(df: DataFrame, prefix: str = "") -> DataFrame:
    """Rename state columns of any accepted alias (wake, s1, REM, prob_W ...) to prob_*, in state order.

    Raises if a state is missing or named twice; other columns stay in front.
    """
    found: dict[str, str] = {}
    for name in df.columns:
        stage = STAGE_ALIASES.get(name.lower().removeprefix(prefix.lower()).removeprefix("prob_"))
        if stage:
            if stage in found:
                raise ValueError(f"state {stage} comes from both {found[stage]} and {name}")
            found[stage] = name
    missing = [s for s in STAGES if s not in found]
    if missing:
        raise ValueError(f"no column for {missing}")
    rest = [c for c in df.columns if c not in found.values()]
    return df.select(*rest, *[F.col(found[s]).cast("double").alias(f"prob_{s}") for s in STAGES])


def probability_array(df: DataFrame, column: str) -> DataFrame:
    """An array of five probabilities in state order as columns prob_*; arrays of another length are NULL in all five."""
    five = F.when(F.size(column) == len(STAGES), F.col(column))
    return df.select(*[c for c in df.columns if c != column], *[F.get(five, F.lit(i)).cast("double").alias(name) for i, name in enumerate(PROBABILITIES)])


def relative_change(base: Column, follow: Column, epsilon: float = 1e-6) -> Column:
    """Change over the signed base, whose size counts as epsilon at least; the sign of 0 is +."""
    return (follow - base) / (F.when(base < 0, -1.0).otherwise(1.0) * F.greatest(F.abs(base), F.lit(epsilon)))


def logit(p: Column, epsilon: float = 1e-6, strict: bool = False) -> Column:
    """Log odds of p clipped to [epsilon, 1 - epsilon]; NULL for NULL, and outside [0, 1] NULL, or an error if ``strict``."""
    clipped = F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))
    inside = F.when(p.between(0.0, 1.0), F.ln(clipped / (1 - clipped)))
    return F.when(p.isNotNull() & ~p.between(0.0, 1.0), F.raise_error(F.concat(F.lit("not a probability: "), p.cast("string"))).cast("double")).otherwise(inside) if strict else inside


def stars(p: Column, cuts: tuple[float, ...] = (0.001, 0.01, 0.05)) -> Column:
    """One star per cut that p is below, '' for none or NULL."""
    n = reduce(lambda a, b: a + b, [F.when(p < c, 1).otherwise(0) for c in cuts])
    return F.repeat(F.lit("*"), n)


def minus_log10(p: Column, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def window_label(t: Column, windows: dict[str, tuple[float, float]], default: str = "outside") -> Column:
    """Name of the first half-open window [start, end) that holds t."""
    inside = reduce(lambda e, kv: e.when((t >= kv[1][0]) & (t < kv[1][1]), F.lit(kv[0])), windows.items(), F.when(F.lit(False), F.lit("")))
    return inside.otherwise(F.lit(default))


def check_windows(windows: dict[str, tuple[float, float]]) -> None:
    """Raise unless every window ends after its start and none overlap; touching is fine."""
    spans = sorted(windows.values())
    if any(b <= a for a, b in spans):
        raise ValueError("a window must end after its start")
    if any(later[0] < earlier[1] for earlier, later in zip(spans, spans[1:], strict=False)):
        raise ValueError("windows overlap")
