"""Column expressions: severity, noise, scores, text joins, intervals. All stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillflow.schemas import SEVERITIES


def joined(values: Column, sep: str = "|") -> Column:
    """Distinct non-null values as sorted text."""
    return F.array_join(F.array_sort(F.collect_set(values.cast("string"))), sep)


def by_parameter(table: Mapping[str, object], parameter: Column, default=None) -> Column:
    """A value by parameter, from a table of a few entries (becomes a CASE, so no join)."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(parameter == k, F.lit(v)).otherwise(out)
    return out


def severity(parameter: Column, size: Column, thresholds: Mapping[str, tuple[float, float, float]]) -> Column:
    """Inclusive tiers; a parameter without thresholds is always normal."""
    out = F.lit(SEVERITIES[0])
    for name, levels in thresholds.items():
        tier = F.lit(SEVERITIES[0])
        for label, level in zip(SEVERITIES[1:], levels):
            tier = F.when(size >= F.lit(float(level)), label).otherwise(tier)
        out = F.when(parameter == name, tier).otherwise(out)
    return out


def severity_rank(label: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), label).cast("int") - 1


def noise_scale(parameter: Column, truth: Column, spec: Mapping[str, tuple[float, float]], floor: float = 1e-9) -> Column:
    """absolute + relative * |truth|, at least ``floor``; 0 for a parameter without an instrument."""
    out = F.lit(0.0)
    for name, (absolute, relative) in spec.items():
        scale = F.greatest(F.lit(absolute) + F.lit(relative) * F.abs(truth), F.lit(floor))
        out = F.when(parameter == name, scale).otherwise(out)
    return out


def gaussian(seed: int | Column, *key: Column) -> Column:
    """A standard normal draw that depends only on the seed and the row's key, so adding rows shifts nothing."""

    seed = seed if isinstance(seed, Column) else F.lit(seed)

    def unit(salt: int) -> Column:
        h = F.pmod(F.xxhash64(seed, F.lit(salt), *key), F.lit(1 << 52))
        return (h.cast("double") + 0.5) / float(1 << 52)

    return F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * 3.141592653589793 * unit(2))


def ratio_or_infinite(a: Column, b: Column) -> Column:
    """a / b for a >= 0, without a division by zero: infinite for a > 0, null (no evidence) for 0 / 0."""
    return F.when(b != 0, F.try_divide(a, b)).when(a > 0, F.lit(float("inf")))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def phase(states: Column) -> Column:
    """The phase of an event from its sorted, pipe-joined ground-truth states."""
    tokens = F.array_distinct(F.filter(F.transform(F.split(states, r"\|"), lambda x: F.trim(x)), lambda x: x != ""))
    return (
        F.when(F.array_contains(tokens, "fault_active"), "primary")
        .when(tokens == F.array(F.lit("recovery")), "recovery_transient")
        .when(tokens == F.array(F.lit("normal")), "pre_fault_false_positive")
        .otherwise("mixed_or_unknown")
    )


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of a proportion, within 0 and 1; null without trials."""
    p = F.try_divide(hits.cast("double"), n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    low, high = F.try_divide(centre - half, d), F.try_divide(centre + half, d)
    some = n > 0
    return F.when(some, F.greatest(low, F.lit(0.0))), F.when(some, F.least(high, F.lit(1.0)))


def clock(seconds: Column) -> Column:
    """Whole hours as HH:00."""
    return F.format_string("%02d:00", F.floor(seconds / 3600).cast("long"))


def scenario_name(fault: Column, target: Column, sev: Column, start: Column, end: Column) -> Column:
    """type_target_sevNN_tSS_EE; without an end, ``end``. Halves round to even."""
    last = F.when(end.isNull(), "end").otherwise(F.format_string("%02d", end.cast("long")))
    return F.concat_ws(
        "_", fault, target, F.format_string("sev%02d", F.bround(sev * 100).cast("long")), F.format_string("t%02d", start.cast("long")), last
    )


def state_at(t: Column, start: Column, end: Column) -> Column:
    """Half-open fault window [start, end); without an end the fault lasts."""
    return F.when(t < start, "normal").when(end.isNull() | (t < end), "fault_active").otherwise("recovery")
