"""What views derive from rows: filters as typed, labels, fallbacks, line segments, cached texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titerloom.functions import keys as K
from titerloom.functions import numbers as N
from titerloom.functions.binding import let

def text_filter(rows: DataFrame, typed: str, *columns: str) -> DataFrame:
    """Rows in which the typed text occurs, in whatever case, in the columns taken together."""
    asked = typed.strip().lower()
    if not asked:
        return rows
    parts = [F.array_join(c, " ") if t.startswith("array") else F.col(c) for c, t in rows.select(*columns).dtypes]
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(asked)))


def suggestions(tags: DataFrame, typed: str, chosen: list[str]) -> DataFrame:
    out = text_filter(tags.select("tag").distinct(), typed, "tag")
    return out.where(~F.col("tag").isin(chosen)) if chosen else out


def processing_label() -> Column:
    """Of a file's row with its progress: the first step that isn't done yet names it."""
    c = F.col
    steps = (
        F.when(c("measurement_pages_done") < c("measurement_pages_total"), F.lit("Extracting measurements"))
        .when(c("total_measurements") > c("ready_measurements"), F.lit("Normalizing measurements"))
        .when(c("text_pages_done") < c("text_pages_total"), F.lit("Extracting text"))
        .when(c("text_assembled_at").isNull(), F.lit("Assembling text"))
        .when(~c("summary_ready"), F.lit("Generating summary"))
        .when(~c("source_ready"), F.lit("Resolving source"))
        .otherwise(F.lit("Processing"))
    )
    return (
        F.when(c("status") == "error", F.coalesce(F.nullif(c("processing_error"), F.lit("")), F.lit("Processing failed")))
        .when(c("status") == "uploaded", F.lit("Not processed"))
        .when(c("status") == "queued", F.lit("Queued"))
        .when(c("status") == "complete", F.when(c("search_ready"), F.lit("Complete")).otherwise(F.lit("Refreshing search")))
        .otherwise(steps)
    )


def source_label(tags: Column, filename: Column) -> Column:
    source = F.filter(tags, K.is_source_tag)
    return F.coalesce(F.when(F.size(source) > 0, K.source_tag_value(F.try_element_at(source, F.lit(1)))), K.blank_to_null(K.strip(filename)), F.lit("—"))


def shown_original(field: Column, canonical: Column, missing: Column, edited: Column) -> Column:
    """Where a conversion is missing, the original stands in, unless the user edited the field."""
    return F.when(missing & ~edited, field).otherwise(canonical)


def unit_pair(text: Column) -> Column:
    """struct(canonical, original, has_original) of `canonical | original` as typed."""
    bar = F.instr(text, "|")
    left = F.when(bar > 0, F.substring(text, F.lit(1), bar - 1)).otherwise(text)
    right = F.when(bar > 0, F.substring(text, bar + 1, F.length(text)))
    return F.struct(K.optional_text(left).alias("canonical"), K.optional_text(right).alias("original"), (bar > 0).alias("has_original"))


def page_text(pages: Column) -> Column:
    """One text of an array of struct(index, text): in order, trimmed, blank ones left out."""
    texts = F.transform(F.array_sort(pages, lambda a, b: F.when(a["index"] < b["index"], -1).when(a["index"] > b["index"], 1).otherwise(0)), lambda p: K.optional_text(p["text"]))
    return K.blank_to_null(F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n\n"))


#: A string with its escapes, a brace, or what stands between them.
_JSON_PIECES = r'(?s)"(?:[^"\\]++|\\.)*+"?|[{}]|[^"{}]++'


def without_fences(text: Column) -> Column:
    """A reply less a first line of ``` and what follows the last ```."""
    x = K.strip(text)
    newline = F.instr(x, "\n")
    body = F.when(x.startswith("```") & (newline > 0), F.substring(x, newline + 1, F.length(x))).otherwise(x)
    closed = F.when(body.endswith("```"), F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(body)
    return K.strip(closed)


def first_object(text: Column) -> Column:
    """From the first { to the } that closes it; braces in strings don't count. Null if none closes."""
    rest = F.substring(text, F.instr(text, "{"), F.length(text))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("read"), F.lit(0).alias("end"))
    depth = lambda s, t: s["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
    step = lambda s, t: F.when(s["end"] > 0, s).otherwise(F.struct(depth(s, t).alias("depth"), (s["read"] + F.length(t)).alias("read"), F.when((t == "}") & (depth(s, t) == 0), s["read"] + 1).otherwise(F.lit(0)).alias("end")))
    walked = let(rest, lambda r: F.struct(r.alias("r"), F.aggregate(F.regexp_extract_all(r, F.lit(_JSON_PIECES), F.lit(0)), start, step)["end"].alias("end")))
    return F.when(F.instr(text, "{") > 0, let(walked, lambda w: F.when(w["end"] > 0, F.substring(w["r"], F.lit(1), w["end"]))))


def json_object(text: Column) -> Column:
    """The first object of a reply, less fences and talk around it; a reply that is a list stays one. Null
    without either. Whether it parses is for from_json to say, which gives null where it doesn't."""
    is_list = lambda x: x.startswith("[") & x.endswith("]") & F.try_parse_json(x).isNotNull()
    return let(without_fences(text), lambda x: F.when(is_list(x), x).otherwise(first_object(x)))


def segments(points: DataFrame) -> DataFrame:
    """points: series, id, x, y, out (beyond the range). Lines between neighbours, in one colour
    each; where the state changes a line is cut in the middle."""
    w = Window.partitionBy("series").orderBy("x", "id")
    nxt = points.select("series", "id", "x", "y", "out", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"), F.lead("out").over(w).alias("out2")).where("x2 is not null")
    mx, my = (F.col("x") + F.col("x2")) / 2, (F.col("y") + F.col("y2")) / 2
    piece = lambda k, a, b, c, d, o: F.struct(F.lit(k).alias("part"), a.cast("double").alias("x1"), b.cast("double").alias("y1"), c.cast("double").alias("x2"), d.cast("double").alias("y2"), o.alias("out"))
    whole = F.array(piece(0, F.col("x"), F.col("y"), F.col("x2"), F.col("y2"), F.col("out")))
    halves = F.array(piece(0, F.col("x"), F.col("y"), mx, my, F.col("out")), piece(1, mx, my, F.col("x2"), F.col("y2"), F.col("out2")))
    return nxt.select("series", "id", F.explode(F.when(F.col("out") == F.col("out2"), whole).otherwise(halves)).alias("s")).select("series", "id", "s.*")


def cached_insights(current: DataFrame, cache: DataFrame) -> DataFrame:
    """current: marker, signature, insight (the fallback). A cached text holds while its signature
    does; fresh says whether it was used."""
    c = cache.select(F.col("marker").alias("__m"), F.col("signature").alias("__s"), F.col("text").alias("__t"))
    j = current.join(c, (current["marker"] == F.col("__m")) & (current["signature"] == F.col("__s")), "left")
    return j.select("marker", "signature", F.coalesce("__t", "insight").alias("insight"), F.col("__t").isNotNull().alias("fresh"))


def history_lines(rows: DataFrame) -> DataFrame:
    """A line for each of a marker's last rows, as a reader is given them."""
    value = N.value_text(F.col("value"), F.col("text"), F.lit(None).cast("string"))
    return rows.select("marker", "rn", F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd"), F.coalesce(value, F.lit("unavailable")), N.range_text(F.col("low"), F.col("high"))).alias("line"))


def group_order(markers: DataFrame, groups: DataFrame) -> DataFrame:
    """markers (marker, group_name) with their place: by the groups' order, groups unknown to it after
    them by name, markers by name."""
    g = groups.select(F.col("name").alias("group_name"), "display_order")
    return markers.join(g, "group_name", "left").orderBy(F.asc_nulls_last("display_order"), "group_name", "marker")


def new_groups(names: DataFrame, groups: DataFrame) -> DataFrame:
    """groups with the names it lacks, by name, ten places apart after its last."""
    fresh = names.select(F.trim("name").alias("name")).where("name != ''").distinct().join(groups, "name", "left_anti")
    top = groups.agg(F.coalesce(F.max("display_order"), F.lit(0)).alias("m")).first()["m"]
    numbered = fresh.withColumn("display_order", (F.row_number().over(Window.orderBy("name")) * 10 + top).cast("int"))
    return groups.unionByName(numbered)


def progress_summary(measured: Column, texts: Column, ready: Column) -> Column:
    """Three counts, each a struct(done, total), in one line."""
    part = lambda head, x, unit="": F.concat(F.lit(head), x["done"].cast("string"), F.lit("/"), x["total"].cast("string"), F.lit(unit))
    return F.concat_ws(" · ", part("Measurements ", measured, "p"), part("Text ", texts, "p"), part("Ready markers ", ready))


def shown_unit(unit: Column) -> Column:
    """A unit; null for none and for the unit of plain numbers."""
    return F.when((unit != "") & (unit != "1"), unit)


def conversion_warning(missing: Column, unit: Column) -> Column:
    return F.when(F.coalesce(missing, F.lit(False)), F.concat_ws(" for ", F.lit("No conversion rule"), shown_unit(unit)))


def marker_names(names: Column) -> Column:
    """Trimmed, blanks left out, each once, in order."""
    return F.array_distinct(F.filter(F.transform(names, lambda n: K.strip(n)), lambda n: n != ""))


def export_name(names: Column) -> Column:
    """What a file of these markers' histories is called: up to three names, and how many if there are more."""
    head = F.array_join(F.transform(F.slice(names, 1, 3), K.slug), "-")
    return F.concat(head, F.when(F.size(names) > 3, F.concat(F.lit("-"), F.size(names).cast("string"), F.lit("-markers"))).otherwise(F.lit("")), F.lit("-history"))


def export_path(names: Column) -> Column:
    wanted = marker_names(names)
    return F.when(F.size(wanted) == 0, F.lit("/exports")).otherwise(F.concat(F.lit("/exports?"), F.array_join(F.transform(wanted, lambda n: F.concat(F.lit("marker="), F.url_encode(n))), "&")))


def prompt_line(name: Column, value: Column, text: Column, unit: Column, low: Column, high: Column) -> Column:
    """A result as a reader is asked to explain it; a word comes before a number."""
    span = F.concat(F.lit(" (ref "), low, F.lit("–"), high, F.lit(")"))
    return F.concat(F.lit("- **"), name, F.lit("**: "), F.coalesce(text, value, F.lit("None")), F.coalesce(F.concat(F.lit(" "), F.nullif(unit, F.lit(""))), F.lit("")), F.coalesce(span, F.lit("")))


def medical_payload(files: DataFrame, measurements: DataFrame) -> DataFrame:
    """file_id, payload: what was read of a file, as one JSON text: its date, source and resolved results, by
    id; a result's value is its number, else its word. files: file_id, lab_date, source_name; dates are texts."""
    rows = measurements.where("normalization_status = 'resolved'")
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("qualitative_value").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    value = F.coalesce(F.col("original_value").cast("string"), F.nullif(quoted, F.lit("")), F.lit("null"))
    rest = F.to_json(F.struct(F.col("original_unit").alias("unit"), F.col("original_reference_low").alias("reference_low"), F.col("original_reference_high").alias("reference_high"), "measured_at", "page_number"), {"ignoreNullFields": "false"})
    name = F.regexp_replace(F.to_json(F.struct("marker_name"), {"ignoreNullFields": "false"}), r"\}$", "")
    item = F.concat(name, F.lit(',"value":'), value, F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
    g = rows.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", item.alias("j")))), lambda x: x["j"]), ",").alias("items"))
    head = F.regexp_replace(F.to_json(F.struct("lab_date", F.col("source_name").alias("source")), {"ignoreNullFields": "false"}), r"\}$", "")
    return files.join(g, "file_id", "left").select("file_id", F.concat(head, F.lit(',"measurements":['), F.coalesce("items", F.lit("")), F.lit("]}")).alias("payload"))


def job_statuses(keys: DataFrame, jobs: DataFrame, task_type: str) -> DataFrame:
    """Each wanted task_key that has a job of the type, once, with the job's status; blank keys are none."""
    wanted = keys.where("task_key <> ''").select("task_key").distinct()
    return wanted.join(jobs.where(F.col("task_type") == task_type).select("task_key", "status"), "task_key")


def marker_count(overview: DataFrame) -> DataFrame:
    """One number: the markers of all groups (a list a group)."""
    return overview.agg(F.coalesce(F.sum(F.size("markers")), F.lit(0)).alias("markers"))
