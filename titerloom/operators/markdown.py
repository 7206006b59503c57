"""Reports in Markdown as lines: each line is a row with its place, so that a sink only sorts.

reports: report, kind (markers, file or file-history), title, lab_date, uploaded (texts, null without a file) and
tags. rows: one for each result of each marker in a report's history: report, marker, group_name, id, ts, value
(as it is shown, with its mark), unit, reference, source, page, date (texts), current (of the file at
hand) and trend (of the marker).

A report of one marker is its history. Any other begins with a summary: of markers their latest results,
of a file its own; a report of markers or of a file's history then has each marker's history. Groups stand in
their names' order, in them the newest first, then markers by name. Names are in the order of their code
points; undated results are the oldest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerloom.functions import keys as K
from titerloom.operators.reports import markdown_row

#: Heads of the tables.
HISTORY = ("Date", "Value", "Unit", "Reference", "Source", "Page")
SUMMARY = ("Marker", "Value", "Unit", "Reference", "Date")
_PLACE = "struct<part: int, group: string, newest: long, marker: string, line: int, later: long, id: long>"


def _place(part: int, group: Column | None = None, newest: Column | None = None, marker: Column | None = None, line: int = 0, later: Column | None = None, id_: Column | None = None) -> Column:
    text, number = F.lit(""), F.lit(0).cast("long")
    return F.struct(F.lit(part).alias("part"), (group if group is not None else text).alias("group"), (newest if newest is not None else number).alias("newest"), (marker if marker is not None else text).alias("marker"), F.lit(line).alias("line"), (later if later is not None else number).alias("later"), (id_ if id_ is not None else number).alias("id"))


def _line(rows: DataFrame, place: Column, text: Column) -> DataFrame:
    return rows.select("report", place.alias("place"), text.alias("text"))


def _head(*names: str) -> tuple[Column, Column]:
    return F.lit("| " + " | ".join(names) + " |"), F.lit("| " + " | ".join("---" for _ in names) + " |")


def lines(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """report, place, text: the lines of every report, to be sorted by place."""
    label = F.coalesce(K.blank_to_null(K.strip(F.col("group_name"))), F.lit("Ungrouped"))
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    whole = rows.withColumns({"group": label, "newer": -F.coalesce(F.unix_micros("ts"), F.lit(-(2**62)))}).join(reports.select("report", "kind"), "report")
    first = F.max_by(F.struct("newer", "id"), F.struct((-F.col("newer")).alias("t"), "id"))
    shown = F.max_by(F.struct("newer", "id"), F.when(F.col("current"), F.struct((-F.col("newer")).alias("t"), "id")))
    sections = whole.groupBy("report", "kind", "group", "marker").agg(first.alias("latest"), F.coalesce(shown, first).alias("at"))
    alone = sections.groupBy("report").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.col("n") == 1)
    known = reports.join(alone, "report", "left").withColumn("single", (F.col("kind") == "markers") & F.coalesce("one", F.lit(False)))
    of = known.select("report", "single", "kind")
    many, single = known.where("not single"), known.where("single")

    # The head: title, and what the file is.
    out = _line(known, _place(0), F.concat(F.lit("# "), F.col("title")))
    focal = many.where("lab_date is not null or uploaded is not null")
    facts = {1: F.lit(""), 2: F.concat(F.lit("- Lab date: "), dash("lab_date")), 3: F.concat(F.lit("- Uploaded: "), dash("uploaded"))}
    for k, text in facts.items():
        out = out.unionByName(_line(focal, _place(0, line=k), text))
    tagged = focal.where(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0)
    out = out.unionByName(_line(tagged, _place(0, line=4), F.concat(F.lit("- Tags: "), F.array_join("tags", ", "))))

    # The summary.
    rest = sections.join(of.drop("kind"), "report").where("not single")
    latest = rest.where("kind = 'markers'").select("report", F.col("latest.id").alias("id"), "marker")
    own = whole.where("kind <> 'markers' and current").select("report", "id", "marker")
    chosen = whole.join(latest.unionByName(own), ["report", "marker", "id"], "left_semi").where("kind = 'markers' or current")
    paged = F.col("kind") != "markers"
    table = {1: lambda p: _head(*SUMMARY, *(["Page"] if p else []), "Trend")[0], 2: lambda p: _head(*SUMMARY, *(["Page"] if p else []), "Trend")[1]}
    out = out.unionByName(_line(many, _place(1), F.lit("")))
    for k, text in table.items():
        out = out.unionByName(_line(many, _place(1, line=k), F.when(paged, text(True)).otherwise(text(False))))
    blank = [F.lit("")] * 5
    groups = chosen.select("report", "kind", "group").distinct()
    bold = F.concat(F.lit("**"), F.col("group"), F.lit("**"))
    out = out.unionByName(_line(groups, _place(2, F.col("group"), F.lit(-(2**63)).cast("long")), F.when(paged, markdown_row(bold, *blank, F.lit(""))).otherwise(markdown_row(bold, *blank))))
    cells = [F.col("marker"), F.col("value"), dash("unit"), dash("reference"), dash("date")]
    row = F.when(paged, markdown_row(*cells, dash("page"), dash("trend"))).otherwise(markdown_row(*cells, dash("trend")))
    out = out.unionByName(_line(chosen, _place(2, F.col("group"), F.col("newer"), F.col("marker"), later=-F.col("id")), row))

    # Histories.
    told = sections.join(of.drop("kind"), "report").where("single or kind <> 'file'")
    at = lambda line, later=None, id_=None: _place(3, F.col("group"), F.col("at.newer"), F.col("marker"), line, later, id_)
    mine = F.col("kind") == "file-history"
    heads = {0: F.lit(""), 1: F.concat(F.lit("### "), F.col("marker")), 2: F.lit("")}
    for k, text in heads.items():
        out = out.unionByName(_line(told.where("not single" if k else "true"), at(k), text))
    for k, (plain, marked) in enumerate(zip(_head(*HISTORY), _head(*HISTORY, "Current file"), strict=True)):
        out = out.unionByName(_line(told, at(3 + k), F.when(mine, marked).otherwise(plain)))
    rows_of = whole.drop("kind").join(told.select("report", "marker", "group", "at", "kind"), ["report", "marker", "group"])
    cells = [dash("date"), F.col("value"), dash("unit"), dash("reference"), dash("source"), dash("page")]
    row = F.when(mine, markdown_row(*cells, F.when(F.col("current"), F.lit("Yes")).otherwise(F.lit("")))).otherwise(markdown_row(*cells))
    out = out.unionByName(_line(rows_of, at(9, F.col("newer"), -F.col("id")), row))
    # A last, empty line: the file ends with a line end.
    return out.unionByName(_line(known, _place(9), F.lit("")))
