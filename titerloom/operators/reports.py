"""Report rows: one model for tables on screen, in Markdown and in print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titerloom.functions import keys as K
from titerloom.functions import numbers as N
from titerloom.functions import status as S
from titerloom.functions.binding import let


def report_rows(rows: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Display columns of results, in report order keys. current: id of the rows of the file at
    hand. rows: marker, group_name, id, ts, value, text, flag, low, high, unit."""
    shown = rows.withColumns(
        {
            "group_label": F.coalesce(K.blank_to_null(K.strip(F.col("group_name"))), F.lit("Ungrouped")),
            "value_label": N.client_number(F.col("value"), F.col("text")),
            "range_label": N.range_text(F.col("low"), F.col("high")),
            "class": S.client_class(F.col("value"), F.col("flag"), F.col("low"), F.col("high")),
        }
    )
    if current is not None:
        shown = shown.join(current.select(F.col("id").alias("__c")).distinct(), shown["id"] == F.col("__c"), "left").withColumn("current", F.col("__c").isNotNull()).drop("__c")
    return shown


def in_report_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("group_label", F.desc("ts"), "marker", F.desc("id"))


def with_group_heads(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows with head: true on the first row of each group, in order, within `by`."""
    w = Window.partitionBy(*by).orderBy(*order)
    last = F.lag("group_label").over(w)
    return rows.withColumn("head", last.isNull() | (last != F.col("group_label")))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(K.markdown_cell(c.cast("string")), F.lit("")) for c in cells]), F.lit(" |"))


#: Marks before a value.
MARKS = {"low": "⬇️ ", "high": "⬆️ ", "normal": "↔️ "}


def mark(class_: Column, worded: Column) -> Column:
    """worded: whether the result is a word or a flag, which bears no mark."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for p in MARKS.items() for x in p]), class_)
    return F.when(worded | known.isNull(), F.lit("")).otherwise(known)


def chart_points(rows: DataFrame) -> DataFrame:
    """Numbers and flags of a marker on one axis of time; undated rows stand at noon of the first
    dated row's month's first day, or, with no dated row at all, at their place in the order."""
    first = rows.groupBy("marker").agg(F.min("ts").alias("__first"), F.count_if(F.col("ts").isNull()).alias("undated"))
    j = rows.join(first, "marker")
    kind = F.when(F.col("value").isNotNull(), F.lit("number")).when(F.col("flag").isNotNull(), F.lit("flag"))
    order = Window.partitionBy("marker").orderBy(F.asc_nulls_first("ts"), "id")
    noon = F.date_trunc("month", "__first") + F.make_dt_interval(hours=F.lit(12))
    x = F.coalesce(F.unix_millis("ts"), F.unix_millis(noon), F.row_number().over(order).cast("long") - 1)
    return j.withColumn("kind", kind).where("kind is not null").select("marker", "id", "kind", x.alias("x"), F.coalesce("value", F.col("flag").cast("double")).alias("y"), "undated")


def gauge_bounds(value: Column, low: Column, high: Column) -> Column:
    """struct(a, b): the stretch of axis a single value is shown on."""
    both = low.isNotNull() & high.isNotNull()
    margin = F.when(both, F.greatest((high - low) * 0.4, F.lit(0.5))).otherwise(F.greatest(F.abs(value) * 0.2, F.lit(1.0)))
    first, last = F.when(both, low).otherwise(value) - margin, F.when(both, high).otherwise(value) + margin
    return F.struct(F.least(first, value - 0.5).alias("a"), F.greatest(last, value + 0.5).alias("b"))


#: Steps of an axis within a power of ten, and the axis of no value at all.
STEPS = (1.0, 2.0, 2.5, 5.0, 10.0)
NO_AXIS = (0.0, 0.5, 1.0)


def decimals(x: Column) -> Column:
    """Digits after the point in the shortest text of a number."""
    shown = x.cast("string")
    part = F.nullif(F.regexp_extract(shown, r"\.(\d+)", 1), F.lit("0"))
    power = F.coalesce(F.nullif(F.regexp_extract(shown, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    return F.when(x == F.floor(x), F.lit(0)).otherwise(F.greatest(F.lit(0), F.coalesce(F.length(part), F.lit(0)) - power))


def rounded(x: Column, digits: Column) -> Column:
    """To that many digits; halves go up."""
    factor = F.pow(F.lit(10.0), digits)
    return F.floor(x * factor + 0.5) / factor


def nice_axis(lo: Column, hi: Column, marked: Column | None = None, least: int = 4, aim: int = 6, most: int = 8) -> Column:
    """Ticks from below lo to above hi at round steps, as an array. Of the steps that least to most ticks
    would ask for, the one with the lowest score: values in marked that no tick meets, ticks beyond or
    short of the bounds, distance from aim, space left over, digits; of equals the smallest step."""
    marks = F.filter(F.coalesce(marked, F.array().cast("array<double>")) if marked is not None else F.array().cast("array<double>"), lambda m: m.isNotNull() & ~F.isnan(m) & (F.abs(m) < float("inf")))
    pad = F.when(lo == 0, F.lit(1.0)).otherwise(F.abs(lo) * 0.2)
    single = lo == hi
    ends = F.struct(F.when(single, lo - pad).otherwise(lo).alias("lo"), F.when(single, hi + pad).otherwise(hi).alias("hi"), marks.alias("marks"))

    def step_for(e: Column, ticks: Column) -> Column:
        def chosen(x: Column) -> Column:
            part = x["raw"] / x["power"]
            factor = F.coalesce(F.get(F.filter(F.array(*map(F.lit, STEPS)), lambda s: part <= s), F.lit(0)), F.lit(10.0))
            return factor * x["power"]

        raw = (e["hi"] - e["lo"]) / F.greatest(ticks - 1, F.lit(1))
        return let(let(raw, lambda r: F.struct(r.alias("raw"), F.pow(F.lit(10.0), F.floor(F.log10(r))).alias("power"))), chosen)

    def scale(e: Column, step: Column) -> Column:
        digits = decimals(step) + 6
        edge = lambda x: rounded(x * step, digits)
        span = F.struct(edge(F.floor(e["lo"] / step)).alias("start"), edge(F.ceil(e["hi"] / step)).alias("stop"), digits.alias("digits"))

        def ticks(s: Column) -> Column:
            n = F.greatest(F.lit(2), F.floor((s["stop"] - s["start"]) / step + 0.5).cast("int") + 1)
            return F.transform(F.sequence(F.lit(0), n - 1), lambda k: rounded(s["start"] + step * k, s["digits"]))

        return let(span, lambda s: let(ticks(s), lambda t: F.struct(score(e, t).alias("score"), step.alias("step"), t.alias("ticks"))))

    def score(e: Column, t: Column) -> Column:
        def total(x: Column) -> Column:
            near = F.greatest(x["step"] * 0.05, F.pow(F.lit(10.0), -(x["digits"] + 2)))
            missed = F.size(F.filter(e["marks"], lambda m: ~F.exists(t, lambda k: F.abs(k - m) <= near)))
            n, span = F.size(t), e["hi"] - e["lo"]
            over, under = F.greatest(n - most, F.lit(0)) * 4, F.greatest(least - n, F.lit(0)) * 4
            spare = F.when(span == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.element_at(t, -1) - t[0] - span) / span)
            return missed * 3 + over + under + F.abs(n - aim) + spare + x["digits"] * 0.25

        return let(let(t[1] - t[0], lambda d: F.struct(d.alias("step"), decimals(d).alias("digits"))), total)

    best = let(ends, lambda e: F.array_min(F.transform(F.array_distinct(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda k: step_for(e, k))), lambda s: scale(e, s)))["ticks"])
    return F.when(lo.isNull() | hi.isNull(), F.array(*map(F.lit, NO_AXIS))).otherwise(best)


def axes(spread: DataFrame) -> DataFrame:
    """spread: marker, lo, hi and perhaps marked (values the axis should show) -> marker, first, last, step, ticks."""
    marked = F.col("marked") if "marked" in spread.columns else None
    out = spread.select("marker", nice_axis(F.col("lo"), F.col("hi"), marked).alias("ticks"))
    return out.select("marker", F.element_at("ticks", 1).alias("first"), F.element_at("ticks", -1).alias("last"), (F.element_at("ticks", 2) - F.element_at("ticks", 1)).alias("step"), F.size("ticks").cast("long").alias("n"))


#: What an explanation says without a model's help.
EXPLAINED = {
    "positive": "The latest result is reported as positive.",
    "negative": "The latest result is reported as negative.",
    "qualitative": "The latest result is qualitative, so there is no numeric reference range to compare against.",
    "low": "The latest result is below the reported range, which means it is lower than the lab's usual reference interval for this marker.",
    "high": "The latest result is above the reported range, which means it is higher than the lab's usual reference interval for this marker.",
    "in_range": "The latest result is within the reported range, which means it falls inside the lab's usual reference interval for this marker.",
}


def insight_line(rows: DataFrame) -> DataFrame:
    """Overview rows with insight, an explanation in Markdown: the latest result and its status, the range,
    what the status means, and the change since the result before. A row may have unit."""
    unit = F.col("unit") if "unit" in rows.columns else F.lit(None).cast("string")
    suffix = F.coalesce(F.concat(F.lit(" "), F.nullif(unit, F.lit(""))), F.lit(""))
    at, before = (lambda c: F.col(f"latest.{c}")), (lambda c: F.col(f"previous.{c}"))
    word, former = at("text"), before("text")
    value = F.when(~F.coalesce(at("missing"), F.lit(False)), at("value"))
    old = F.when(~F.coalesce(before("missing"), F.lit(False)), before("value"))
    shown = F.concat(F.coalesce(word, N.general_number(value), F.lit("unavailable")), suffix)
    bold = lambda *x: F.concat(F.lit("**"), *x, F.lit("**"))
    said = lambda k: F.lit(EXPLAINED[k])
    meant = F.when(at("flag"), said("positive")).when(~at("flag"), said("negative")).otherwise(said("qualitative"))
    turned = F.when(former == word, F.concat(F.lit("Compared with the previous result, it is **unchanged** at "), bold(word), F.lit("."))).otherwise(F.concat(F.lit("Compared with the previous result, it changed from "), bold(former), F.lit(" to "), bold(word), F.lit(".")))
    in_words = F.array(F.concat(F.lit("Latest result: "), bold(shown), F.lit(".")), meant, F.when(former.isNotNull(), turned))
    both = F.col("range.low").isNotNull() & F.col("range.high").isNotNull()
    span = F.concat(F.lit("Reference range from the report: "), bold(N.general_number(F.col("range.low")), F.lit(" to "), N.general_number(F.col("range.high")), suffix), F.lit("."))
    change = value - old
    way = F.when(change > 0, F.lit("up")).when(change < 0, F.lit("down")).otherwise(F.lit("unchanged"))
    moved = F.concat(F.lit("Compared with the previous result, the marker is "), bold(way), F.lit(" by "), bold(N.general_number(F.abs(change)), suffix), F.lit("."))
    status = F.col("status")
    places = F.when(status == "low", said("low")).when(status == "high", said("high")).when(status == "in_range", said("in_range"))
    in_numbers = F.array(F.concat(F.lit("Latest value: "), bold(shown), F.lit(". Status: "), bold(F.replace(status, F.lit("_"), F.lit(" "))), F.lit(".")), F.when(both, span), places, F.when(change.isNotNull(), moved))
    body = F.when(value.isNull() & word.isNotNull(), in_words).otherwise(in_numbers)
    return rows.withColumn("insight", F.array_join(F.array_compact(F.concat(F.array(F.concat(F.lit("## "), F.col("marker"))), body)), "\n\n"))
