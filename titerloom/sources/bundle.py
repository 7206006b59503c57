"""The share bundle: everything a reader without a server needs, as one JSON text a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerloom.functions import keys as K
from titerloom.operators import search


def sanitised(files: DataFrame) -> DataFrame:
    """Files without what must not leave the house."""
    none = {c: F.lit(None).cast(t) for c, t in files.dtypes if c in ("ocr_raw", "summary", "summary_generated_at", "explanation")}
    return files.withColumns(none | ({"filepath": F.lit("")} if "filepath" in files.columns else {}))


def file_parts(files: DataFrame, measurements: DataFrame, tags: DataFrame) -> DataFrame:
    """file_id, json: each file with its measurements and tags. One row a file, so that no task
    or driver holds the bundle whole; a writer streams the rows out."""
    m = measurements.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct(*sorted(c for c in measurements.columns if c != "file_id")))).alias("measurements"))
    t = tags.groupBy("file_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    j = sanitised(files).join(m, "file_id", "left").join(t, "file_id", "left")
    return j.select("file_id", F.to_json(F.struct(*sorted(j.columns)), {"ignoreNullFields": "false"}).alias("json"))


def encoded(parts: DataFrame) -> DataFrame:
    return parts.withColumn("base64", F.base64(F.encode("json", "UTF-8")))


class Bundle:
    """A bundle in a folder, of nested rows, and what a reader asks of it. Filters and columns reach the scan;
    lists stay nested: nothing is flattened to be filtered.

    files: a row a file, with tags, its measurements (a list of structs, by place), page_image_urls and text_preview.
    markers: a row a marker, with its group and that group's place, tags, payload, history and sparkline (lists of structs).
    search: a row a file, with the texts that are searched and marker_names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, files: DataFrame, measurements: DataFrame, file_tags: DataFrame, markers: DataFrame, marker_tags: DataFrame, history: DataFrame, sparkline: DataFrame) -> None:
        """files: file_id, filename, uploaded_at, lab_date, page_count, mime_type, raw, translated, page_image_urls, ...; measurements:
        file_id, id, marker, measured_at, value_text, ...; markers: marker, group_name, display_order, ...; history and sparkline: marker,
        and columns that begin with at (their order) and id. Texts that must not leave the house are left out."""
        nested = lambda df, key, name: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != key]))).alias(name))
        tags = lambda df, key: df.groupBy(key).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
        none = F.array().cast("array<string>")
        ordered = measurements.select("file_id", F.coalesce("measured_at", F.lit("")).alias("at"), "id", *[c for c in measurements.columns if c not in ("file_id", "id")])
        f = sanitised(files).join(tags(file_tags, "file_id"), "file_id", "left").join(nested(ordered, "file_id", "measurements"), "file_id", "left")
        f = f.withColumn("tags", F.coalesce("tags", none)).withColumn("text_preview", F.coalesce("translated", "raw"))
        names = measurements.where("marker is not null").groupBy("file_id").agg(F.sort_array(F.collect_set("marker")).alias("marker_names"))
        lines = measurements.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", F.concat_ws(" ", "marker", "value_text").alias("t")))), lambda x: x["t"]), "\n").alias("measurements_text"))
        texts = {"filename": K.search_text(F.col("filename")), "tags_text": F.array_join("tags", " "), "measurements": F.coalesce("measurements_text", F.lit("")), "translated": K.search_text(F.col("translated")), "raw": K.search_text(F.col("raw"))}
        found = f.select("file_id", "filename", "uploaded_at", "lab_date", "tags", "translated", "raw").join(names, "file_id", "left").join(lines, "file_id", "left")
        documents = found.withColumns(texts | {"marker_names": F.coalesce("marker_names", none)}).drop("measurements_text")
        m = markers.join(tags(marker_tags, "marker"), "marker", "left").join(nested(history, "marker", "history"), "marker", "left").join(nested(sparkline, "marker", "sparkline"), "marker", "left")
        f.write.mode("overwrite").parquet(f"{self.path}/files")
        m.withColumn("tags", F.coalesce("tags", none)).write.mode("overwrite").parquet(f"{self.path}/markers")
        documents.write.mode("overwrite").parquet(f"{self.path}/search")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    @staticmethod
    def _with_all(df: DataFrame, tags: list[str]) -> DataFrame:
        for t in tags:
            df = df.where(F.array_contains("tags", t))
        return df

    def files(self, tags: list[str] | None = None) -> DataFrame:
        """Files that bear every tag, without their measurements."""
        return self._with_all(self._read("files"), tags or []).drop("measurements", "text_preview", "raw", "translated", "page_image_urls")

    def page_info(self, file_id: int) -> DataFrame:
        return self._read("files").where(F.col("file_id") == file_id).select("page_count", "mime_type")

    def page_image(self, file_id: int, page: int) -> DataFrame:
        """url of a page, counted from one; null beyond them."""
        return self._read("files").where(F.col("file_id") == file_id).select(F.get("page_image_urls", F.lit(page - 1)).alias("url"))

    def text_preview(self, file_id: int) -> DataFrame:
        return self._read("files").where(F.col("file_id") == file_id).select("text_preview")

    def measurements(self, file_id: int | None = None) -> DataFrame:
        """Of a file, or of all: by time, then id."""
        f = self._read("files") if file_id is None else self._read("files").where(F.col("file_id") == file_id)
        return f.select("file_id", F.explode("measurements").alias("m")).select("file_id", "m.*").orderBy("at", "id")

    def file_tags(self) -> DataFrame:
        return self._read("files").select(F.explode("tags").alias("tag")).distinct()

    def marker_tags(self) -> DataFrame:
        return self._read("markers").select(F.explode("tags").alias("tag")).distinct()

    def marker_names(self) -> DataFrame:
        return self._read("markers").select("marker")

    def overview(self, tags: list[str] | None = None) -> DataFrame:
        """Markers that bear every tag, in the order of their groups; a group without any is not there."""
        return self._with_all(self._read("markers"), tags or []).drop("history", "sparkline").orderBy(F.asc_nulls_last("display_order"), "group_name", "marker")

    def detail(self, marker: str) -> DataFrame:
        """A marker with its history; no row if the bundle hasn't it."""
        return self._read("markers").where(F.col("marker") == marker).drop("sparkline")

    def sparkline(self, marker: str) -> DataFrame:
        return self._read("markers").where(F.col("marker") == marker).select("sparkline")

    def search(self, query: str, tags: list[str] | None = None) -> DataFrame:
        """Files with every word of the query, by score, then the newest upload; up to four snippets, of the fields in the order of FIELDS."""
        words = K.query_tokens(query)
        held = self._with_all(self._read("search"), tags or [])
        hits = search.offline(held.withColumnRenamed("tags", "tag_list").withColumnRenamed("tags_text", "tags"), query)
        if not words:
            return hits
        every = F.array(*[F.struct(F.lit(f).alias("source"), K.snippet(F.col(f), words).alias("text")) for f in FIELDS])
        shown = hits.withColumn("snippets", F.slice(F.filter(every, lambda x: x["text"].isNotNull()), 1, 4)).drop("translated", "raw", "measurements")
        return shown.orderBy(F.desc("score"), F.desc("uploaded_at"), "file_id")


#: The searched fields, in the order of their snippets.
FIELDS = ("filename", "tags", "measurements", "translated", "raw")


def migrate(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Additive schema change: missing columns appear, null; the rest stays."""
    return table.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in table.columns})


def pending_migrations(all_: DataFrame, applied: DataFrame) -> DataFrame:
    return all_.join(applied, "version", "left_anti").orderBy("version")
