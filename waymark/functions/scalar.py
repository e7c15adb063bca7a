"""Column helpers used by every operator: rounding, scaling, grades, money text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from waymark import fixed


def sql_lit(value) -> str:
    """A value as Spark SQL literal text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value}D"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values) -> str:
    return "array(" + ", ".join(sql_lit(v) for v in values) + ")"


def sql_pick(values, index: str) -> str:
    """SQL text: the value at a zero-based position in a fixed list."""
    return f"element_at({sql_array(values)}, cast(({index}) + 1 as int))"


def lit_map(mapping: dict) -> Column:
    """A literal map column for a dictionary of fixed values."""
    return F.expr("map(" + ", ".join(f"{sql_lit(k)}, {sql_lit(v)}" for k, v in mapping.items()) + ")")


def str_array(values) -> Column:
    values = list(values)
    return F.expr(sql_array(values)) if values else F.expr("cast(array() as array<string>)")


def pick(values, index: Column) -> Column:
    """The value at a zero-based position in a fixed list."""
    return F.element_at(F.expr(sql_array(values)), (index + 1).cast("int"))


def js_round(c: Column) -> Column:
    """Half-up toward plus infinity, unlike Spark's half-away-from-zero round."""
    return F.floor(c + F.lit(0.5))


def clamp(c: Column, low=0, high=100) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def scale(value: Column, low_in, high_in, low_out: float, high_out: float) -> Column:
    """Linear map between two anchors, clamped to the output range; equal anchors give the high end."""
    low_in = low_in if isinstance(low_in, Column) else F.lit(float(low_in))
    high_in = high_in if isinstance(high_in, Column) else F.lit(float(high_in))
    t = (value - low_in) / F.nullif(high_in - low_in, F.lit(0.0))
    mapped = F.lit(float(low_out)) + t * F.lit(float(high_out) - float(low_out))
    bounded = clamp(mapped, float(min(low_out, high_out)), float(max(low_out, high_out)))
    return F.when(high_in == low_in, F.lit(float(high_out))).otherwise(bounded)


def fit_label(score: Column) -> Column:
    ladder = F.lit("weak")
    for bound, label in reversed(fixed.FIT_LABEL_BOUNDS):
        ladder = F.when(score >= bound, F.lit(label)).otherwise(ladder)
    return ladder


def normalize_gpa(value: Column, gpa_scale: Column) -> Column:
    v = value.cast("double")
    return (
        F.when(v.isNull() | F.isnan(v), F.lit(None).cast("double"))
        .when(gpa_scale == "4.0", clamp(v / F.lit(4.0) * F.lit(100.0), 0.0, 100.0))
        .when(gpa_scale == "5.0", clamp(v / F.lit(5.0) * F.lit(100.0), 0.0, 100.0))
        .when(gpa_scale == "IB45", scale(v, 24, 45, 70, 100))
        .otherwise(clamp(v, 0.0, 100.0))
    )


def step(value: Column, steps, floor_value: float) -> Column:
    """Highest step whose bound the value reaches."""
    out = F.lit(float(floor_value))
    for bound, result in reversed(steps):
        out = F.when(value >= bound, F.lit(float(result))).otherwise(out)
    return out


def english_band(test: Column, score: Column) -> Column:
    """Any supported English test on the IELTS scale; unknown stays null."""
    s = score.cast("double")
    return (
        F.when(s.isNull(), F.lit(None).cast("double"))
        .when(test == "IELTS", s)
        .when(test == "TOEFL", step(s, fixed.TOEFL_STEPS, fixed.TOEFL_FLOOR))
        .when(test == "Duolingo", step(s, fixed.DUOLINGO_STEPS, fixed.DUOLINGO_FLOOR))
    )


def format_usd(value: Column) -> Column:
    return (
        F.when(value.isNull(), F.lit("Unknown"))
        .when(value == 0, F.lit("$0"))
        .otherwise(F.concat(F.lit("$"), F.format_number(js_round(value.cast("double")), 0)))
    )


def num_text(value: Column) -> Column:
    """A number without a trailing '.0', as a reader expects it in a sentence."""
    d = value.cast("double")
    return F.when(d == F.floor(d), F.floor(d).cast("string")).otherwise(d.cast("string"))


def plural(count: Column, one: str, many: str) -> Column:
    return F.when(count == 1, F.lit(one)).otherwise(F.lit(many))


def fill(template: str, **cols) -> Column:
    """Fill the {placeholders} of a fixed sentence with columns."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if not piece:
            continue
        if piece.startswith("{") and piece.endswith("}"):
            parts.append(cols[piece[1:-1]].cast("string"))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def texts(*items: Column) -> Column:
    """The non-null items, in order."""
    return F.array_compact(F.array(*items))


def long_date(d: Column) -> Column:
    return F.date_format(d, "MMMM d, yyyy")


def short_date(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "MMM d, yyyy"), F.lit("Not published"))


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)
