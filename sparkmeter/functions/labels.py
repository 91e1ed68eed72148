"""Display labels: models, projects, numbers, bars, device ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Brand prefix removed from model labels, cut marks and widths of the views.
MODEL_PREFIX = "claude-"
MODEL_DATE_MARK = "-20"
PROJECT_WIDTH = 35
NARROW_WIDTH = 25
BAR_WIDTH = 20
BAR_FULL = "█"
BAR_EMPTY = "░"
DEVICE_ID_LENGTH = 64


def model_label(model: Column) -> Column:
    """Text after the last ``/``, without the brand prefix."""
    name = F.substring_index(model, "/", -1)
    branded = F.contains(F.lower(name), F.lit("claude"))
    return F.when(branded, F.replace(name, F.lit(MODEL_PREFIX), F.lit(""))).otherwise(name)


def narrow_model_label(model: Column) -> Column:
    """Model without brand prefix, cut to the narrow width."""
    return F.substring(F.replace(model, F.lit(MODEL_PREFIX), F.lit("")), 1, NARROW_WIDTH)


def dated_model_label(model: Column) -> Column:
    """Model without brand prefix and without its date suffix."""
    return F.substring_index(
        F.replace(model, F.lit(MODEL_PREFIX), F.lit("")), MODEL_DATE_MARK, 1
    )


def project_label(folder: Column) -> Column:
    """The last two path parts, marked ``.../`` when more than three exist."""
    parts = F.size(F.split(folder, "/"))
    tail = F.substring_index(folder, "/", -2)
    label = (
        F.when(parts > 3, F.concat(F.lit(".../"), tail)).when(parts == 3, tail).otherwise(folder)
    )
    return F.substring(label, 1, PROJECT_WIDTH)


def narrow_project_label(folder: Column) -> Column:
    """The last two path parts, cut to the narrow width."""
    return F.substring(F.substring_index(folder, "/", -2), 1, NARROW_WIDTH)


def human_number(n: Column, billions: str = "bn") -> Column:
    """``1.4bn``, ``523.7M``, ``45.2K`` or the plain number."""
    n = n.cast("bigint")
    return (
        F.when(n >= 1_000_000_000, F.concat(_one_decimal(n, 9), F.lit(billions)))
        .when(n >= 1_000_000, F.concat(_one_decimal(n, 6), F.lit("M")))
        .when(n >= 1_000, F.concat(_one_decimal(n, 3), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def _one_decimal(n: Column, power: int) -> Column:
    """``n / 10**power`` with one decimal, rounded as the binary quotient would be.

    Printed doubles round by their exact binary value: 1150 / 1000 is a little below 1.15 and
    prints 1.1. Only exact decimal ties need that care, and there the binary error is compared
    in integers (quotient times 2**52 is exact below 1024).
    """
    unit = 10**power
    tenths = F.floor(n / F.lit(unit // 10).cast("decimal(20,0)")).cast("bigint")
    rest = n - tenths * (unit // 10)
    quotient = n.cast("double") / F.lit(float(unit))
    mantissa = F.when(quotient < 1024, (quotient * float(2**52)).cast("bigint"))
    error = mantissa.cast("decimal(19,0)") * F.lit(unit).cast("decimal(10,0)") - n.cast(
        "decimal(13,0)"
    ) * F.lit(2**52).cast("decimal(16,0)")
    tie_up = (error > 0) | ((F.coalesce(error, F.lit(0)) == 0) & (tenths % 2 == 1))
    up = (rest * 2 > unit // 10) | ((rest * 2 == unit // 10) & tie_up)
    rounded = tenths + F.when(up, 1).otherwise(0)
    return F.concat(
        F.floor(rounded / F.lit(10).cast("decimal(3,0)")).cast("string"),
        F.lit("."),
        (rounded % 10).cast("string"),
    )


def bar_fill(value: Column, top: Column, width: int = BAR_WIDTH) -> Column:
    """Number of filled cells of a bar: floor(value / top * width), 0 when top is 0."""
    ratio = F.try_divide(value.cast("double"), top.cast("double"))
    return F.coalesce(F.floor(ratio * width), F.lit(0)).cast("bigint")


def text_bar(filled: Column, width: int = BAR_WIDTH) -> Column:
    """A bar drawn with full and empty cells."""
    full = filled.cast("int")
    return F.concat(F.repeat(F.lit(BAR_FULL), full), F.repeat(F.lit(BAR_EMPTY), width - full))


def sanitize_device_id(raw: Column) -> Column:
    """Make a text usable as a device id; null when nothing usable is left."""
    clean = F.regexp_replace(raw, "[^a-zA-Z0-9_-]", "_")
    led = F.when(clean.rlike("^[a-zA-Z0-9]"), clean).otherwise(F.concat(F.lit("x"), clean))
    return F.when(F.length(raw) > 0, F.substring(led, 1, DEVICE_ID_LENGTH))
