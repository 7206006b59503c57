"""Reading, checking, scaling and showing numbers, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from titerloom.functions.binding import let
from titerloom.functions.keys import clean_qualitative, strip, unit_key

#: Powers of ten of the metric prefixes of a unit key.
PREFIXES = {"n": -9, "u": -6, "m": -3, "c": -2, "d": -1, "": 0, "da": 1, "h": 2, "k": 3}
#: Factors tried on a value that lies far off its history.
SCALES = (0.001, 0.01, 0.1, 10.0, 100.0, 1000.0)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def parse_number(text: Column) -> Column:
    """A decimal number with a comma, or with blanks between its groups; null if it is none."""
    x = strip(text)
    x = F.regexp_replace(x, r"(?<=\d)\s+(?=\d{3}(?!\d))", "")
    x = F.regexp_replace(x, r"(\d)\s+(\d)", "$1.$2")

    def decimal(y: Column) -> Column:
        one = F.length(y) - F.length(F.replace(y, F.lit(","), F.lit(""))) == 1
        y = F.when(one, F.regexp_replace(y, r"(\d),(\d)", "$1.$2")).otherwise(y)
        return F.regexp_replace(y, r"\s+", "").try_cast("double")

    return let(let(x, decimal), finite)


def parse_value(text: Column) -> Column:
    """struct(number, text): one of the two is null."""
    return let(parse_number(text), lambda n: F.struct(n.alias("number"), F.when(n.isNull(), clean_qualitative(text)).alias("text")))


def parse_positive_int(text: Column) -> Column:
    n = text.try_cast("int")
    return F.when(n > 0, n)


def scaled(value: Column, factor: Column) -> Column:
    """value times factor; without a factor the value stays."""
    return F.when(factor.isNull(), value).otherwise(value * factor)


def positive_ratio(low: Column, high: Column) -> Column:
    a, b = finite(low), finite(high)
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))


def far_outside(value: Column, low: Column, high: Column, factor: float = 10.0) -> Column:
    """More than factor beyond a positive range; false where anything is missing."""
    v, a, b = finite(value), finite(low), finite(high)
    return F.coalesce((v > 0) & (a > 0) & (b > 0) & ((v < a / factor) | (v > b * factor)), F.lit(False))


def within(value: Column, low: Column, high: Column, margin: float = 0.1, least: float = 1e-9) -> Column:
    """Inside a range widened by a share of each bound."""
    v, a, b = finite(value), F.least(finite(low), finite(high)), F.greatest(finite(low), finite(high))
    a = F.when(finite(low).isNotNull() & finite(high).isNotNull(), a)
    return F.coalesce((v >= a - F.greatest(F.abs(a) * margin, F.lit(least))) & (v <= b + F.greatest(F.abs(b) * margin, F.lit(least))), F.lit(False))


def dimensionless_factor(unit: Column) -> Column:
    """What one of the unit is as a plain ratio; null for a unit with a dimension."""
    key = unit_key(unit)
    powers = F.create_map(*[F.lit(x) for p in PREFIXES.items() for x in p])
    ratio = r"^(da|[numcdhk]?)l/(da|[numcdhk]?)l$"
    top, bottom = F.regexp_extract(key, ratio, 1), F.regexp_extract(key, ratio, 2)
    volume = F.rlike(key, F.lit(ratio))
    return (
        F.when(key == "1", F.lit(1.0))
        .when(key == "%", F.lit(1e-2))
        .when(key.isin("‰", "permille"), F.lit(1e-3))
        .when(volume, F.pow(F.lit(10.0), F.try_element_at(powers, top) - F.try_element_at(powers, bottom)))
    )


def deterministic_factor(original: Column, target: Column) -> Column:
    return dimensionless_factor(original) / dimensionless_factor(target)


def needs_judgement(key: Column) -> Column:
    """Cell counts and the like, whose factor no rule of prefixes gives."""
    plain = F.rlike(key, F.lit(r"^x?10\^?\d+/l$"))
    return F.coalesce(~plain & F.rlike(key, F.lit(r"cells?|zellen|tys|tis|/ul|/μl|/µl")), F.lit(False))


def general_number(x: Column, digits: int = 6) -> Column:
    """As C's %g: significant digits, no trailing zeros, an exponent far from one."""
    shown = F.format_string(f"%.{digits - 1}e", x)
    exponent = F.regexp_extract(shown, r"e([+-]\d+)$", 1).try_cast("int")
    plain = F.regexp_replace(F.regexp_replace(shown.try_cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(shown, r"^(-?\d(?:\.\d+)?)e", 1), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x == 0, F.lit("0")).when((exponent < -4) | (exponent >= digits), F.concat(mantissa, F.lit("e"), F.regexp_extract(shown, r"e([+-]\d+)$", 1))).otherwise(plain)


def value_text(value: Column, text: Column, unit: Column) -> Column:
    """Number, else text, with the unit; the unit alone where there is neither."""
    return F.nullif(F.concat_ws(" ", F.coalesce(F.when(value.isNotNull(), general_number(value)), text), unit), F.lit(""))


def client_number(value: Column, text: Column) -> Column:
    """Text wins; whole numbers as they are; else two decimals, less a trailing .00."""
    two = F.regexp_replace(F.format_string("%.2f", value), r"\.00$", "")
    whole = F.format_string("%.0f", value)
    return F.coalesce(text, F.when(value.isNull(), F.lit("—")).when(value == F.floor(value), whole).otherwise(two))


def range_text(low: Column, high: Column) -> Column:
    a, b = client_number(low, F.lit(None).cast("string")), client_number(high, F.lit(None).cast("string"))
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(a, F.lit("–"), b)).when(low.isNotNull(), F.concat(F.lit("Low "), a)).when(high.isNotNull(), F.concat(F.lit("High "), b)).otherwise(F.lit("—"))


def parse_range(text: Column) -> Column:
    """struct(low, high) of `a-b`, `a-`, `-b`."""
    pattern = r"^\s*(\d+(?:[.,]\d+)?)?\s*[-–]\s*(\d+(?:[.,]\d+)?)?\s*$"
    side = lambda k: F.replace(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.struct(side(1).alias("low"), side(2).alias("high"))


def parse_expression(text: Column) -> Column:
    """struct(text, flag) of `true("x")`, `true`, `false`, `"x"`, `x`."""
    x = strip(text)
    call = r'^(?i)(true|false)\s*\(\s*"([^"]*)"\s*\)$'
    flag = F.lower(F.regexp_extract(x, call, 1))
    word = F.lower(x)
    quoted = F.regexp_extract(x, r'^"([^"]*)"$', 1)
    shown = F.when(flag != "", F.regexp_extract(x, call, 2)).when(word == "true", F.lit("Positive")).when(word == "false", F.lit("Negative")).when(quoted != "", quoted).otherwise(F.nullif(x, F.lit("")))
    value = F.when((flag == "true") | (word == "true"), F.lit(True)).when((flag == "false") | (word == "false"), F.lit(False))
    return F.struct(shown.alias("text"), value.alias("flag"))


def was_rescaled(original: Column, target: Column) -> Column:
    return F.coalesce(F.abs(original - target) > 1e-9 * F.greatest(F.abs(original), F.abs(target), F.lit(1.0)), F.lit(False))


def page_fit(width: Column, height: Column, long_side: int = 3508, short_side: int = 2480) -> Column:
    """struct(width, height) of an image shrunk, never grown, to a page in either orientation."""
    limit_w, limit_h = F.when(width > height, long_side).otherwise(short_side), F.when(width > height, short_side).otherwise(long_side)
    scale = F.least(F.lit(1.0), limit_w / width, limit_h / height)
    return F.struct(F.greatest(F.bround(width * scale), F.lit(1)).cast("int").alias("width"), F.greatest(F.bround(height * scale), F.lit(1)).cast("int").alias("height"))
