"""Thresholds, statuses and derived tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from titerloom.functions.binding import let
from titerloom.functions.keys import clean_qualitative
from titerloom.functions.numbers import finite

_THRESHOLD = r"^(<=|>=|<|>)\s*([+-]?(?:\d+(?:[.,]\d+)?|[.,]\d+))$"


def threshold(text: Column) -> Column:
    """struct(op, limit) of `<5`, `≥ 1,5` and the like; both null otherwise."""
    x = F.replace(F.replace(clean_qualitative(text), F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))

    def parts(y: Column) -> Column:
        op = F.nullif(F.regexp_extract(y, _THRESHOLD, 1), F.lit(""))
        limit = F.replace(F.regexp_extract(y, _THRESHOLD, 2), F.lit(","), F.lit(".")).try_cast("double")
        return let(let(limit, finite), lambda n: F.struct(F.when(n.isNotNull(), op).alias("op"), F.when(op.isNotNull(), n).alias("limit")))

    return let(x, parts)


def threshold_status(op: Column, t: Column, low: Column, high: Column) -> Column:
    """low, in_range or high of a value known only as below or above a limit; null if open."""
    none = low.isNull() & high.isNull()
    below = F.when(low.isNotNull() & (t <= low), F.lit("low")).when(high.isNotNull() & (t <= high) & (low.isNull() | (low <= 0)), F.lit("in_range")).when(none, F.lit("in_range"))
    above = F.when(high.isNotNull() & (t >= high), F.lit("high")).when(low.isNotNull() & (t >= low) & high.isNull(), F.lit("in_range")).when(none, F.lit("high"))
    return F.when(op.isin("<", "<="), below).when(op.isin(">", ">="), above)


def _close(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * 1e-6, F.lit(1e-9)), F.lit(False))


def threshold_result(text: Column, low: Column, high: Column) -> Column:
    """struct(text, flag) a threshold text amounts to, or null."""

    def result(word: Column | str, flag: Column | bool) -> Column:
        return F.struct((F.lit(word) if isinstance(word, str) else word).alias("text"), (F.lit(flag) if isinstance(flag, bool) else flag).alias("flag"))

    def decided(th: Column, status_: Column) -> Column:
        less = th["op"].isin("<", "<=")
        by_status = F.when(status_.isNotNull(), result(status_, status_.isin("low", "high")))
        at_high = F.when(less, result("negative", False)).otherwise(result("positive", True))
        at_low = F.when(less, result("positive", True)).otherwise(result("negative", False))
        both = low.isNotNull() & high.isNotNull()
        return F.when(th["op"].isNull(), F.lit(None)).when(both, by_status).when(_close(th["limit"], high), at_high).when(_close(th["limit"], low), at_low).otherwise(by_status)

    return let(threshold(text), lambda th: let(threshold_status(th["op"], th["limit"], low, high), lambda s: decided(th, s)))


def status(value: Column, text: Column, flag: Column, missing: Column, low: Column, high: Column) -> Column:
    """A result's status against a range; missing: its unit could not be converted."""
    by_threshold = let(threshold(text), lambda th: threshold_status(th["op"], th["limit"], low, high))
    rest = (
        F.when(flag, F.lit("positive"))
        .when(~flag, F.lit("negative"))
        .when(missing | value.isNull(), F.lit("no_range"))
        .when(value < low, F.lit("low"))
        .when(value > high, F.lit("high"))
        .when(low.isNotNull() | high.isNotNull(), F.lit("in_range"))
        .otherwise(F.lit("no_range"))
    )
    return F.coalesce(by_threshold, rest)


def range_position(value: Column, missing: Column, low: Column, high: Column) -> Column:
    return F.when(~missing & (high > low), (value - low) / (high - low))


def range_bucket(status_: Column) -> Column:
    return F.when(status_.isin("negative", "in_range"), F.lit("in")).when(status_.isin("positive", "low", "high"), F.lit("out")).otherwise(F.lit("none"))


def range_tags(n_in: Column, n_out: Column, n_none: Column) -> Column:
    """Tags of a history by how many of its rows fall in, out of, or without a range."""
    any_ = (n_in > 0) | (n_out > 0)
    tags = F.array(
        F.when(any_ & (n_out == 0), F.lit("onlyInRange")),
        F.when(any_ & (n_out > 0) & (n_in == 0), F.lit("onlyOutOfRange")),
        F.when(any_ & (n_out > 0) & ((n_in == 0) | (n_out > n_in)), F.lit("mostlyOutOfRange")),
        F.when(any_ & (n_out > 0), F.lit("someOutOfRange")),
        F.when(n_none > 0, F.lit("noRange")),
    )
    return F.filter(tags, lambda t: t.isNotNull())


def marker_tags(group: Column, n: Column, range_tags_: Column) -> Column:
    own = F.array(F.when(group != "", F.concat(F.lit("group:"), group)), F.when(n == 1, F.lit("singleMeasurement")).when(n > 1, F.lit("multipleMeasurements")))
    return F.concat(F.filter(own, lambda t: t.isNotNull()), range_tags_)


#: Tags that only the system gives.
RESERVED = ("singleMeasurement", "multipleMeasurements", "onlyInRange", "onlyOutOfRange", "mostlyOutOfRange", "someOutOfRange", "noRange")


def user_tags(tags: Column) -> Column:
    return F.filter(F.array_except(tags, F.array(*map(F.lit, RESERVED))), lambda t: ~F.startswith(t, F.lit("group:")))


def client_class(value: Column, flag: Column, low: Column, high: Column) -> Column:
    """A report cell's colour; unlike status() it looks at the flag first and at no threshold text."""
    return (
        F.when(flag, F.lit("positive"))
        .when(~flag, F.lit("normal"))
        .when(value.isNull(), F.lit("neutral"))
        .when(value < low, F.lit("low"))
        .when(value > high, F.lit("high"))
        .when(low.isNull() & high.isNull(), F.lit("neutral"))
        .otherwise(F.lit("normal"))
    )


#: Labels of the statuses.
LABELS = {"low": "Low", "high": "High", "in_range": "In range", "no_range": "No range", "positive": "Positive", "negative": "Negative"}


def label(status_: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]), status_)
