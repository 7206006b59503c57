"""Merging and renaming markers: many requests at once, over one set of tables.

Tables: types (type_id, name, key, unit), aliases (alias_key, alias_name, type_id), rows (id, type_id, ...), tags
(type_id, tag) and insights (type_id, ...). Keys: one type a name, one type an alias key, a tag and an
insight once a type. Each request gets a result row (n, code, reason), as a service would answer; those
with code 200 take effect together, so what comes out keeps the keys (broken_keys() says so).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titerloom.functions import keys as K


@dataclass(frozen=True)
class Tables:
    types: DataFrame
    aliases: DataFrame
    rows: DataFrame
    tags: DataFrame
    insights: DataFrame


def shuffled(df: DataFrame) -> DataFrame:
    """A table of all markers, to be joined by merging. Its size follows the input, but files of ids and what
    is computed from them look small enough to broadcast at millions of rows."""
    return df.hint("merge")


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def merge_results(types: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: n, source, target (type ids). n, source, target, code, reason: 404 where a type isn't there, 409
    where the requests contradict one another: a source merged twice, or into a type that is itself merged."""
    known = lambda c: shuffled(types.select(F.col("type_id").alias(c), F.lit(True).alias(f"has_{c}")))
    r = requests.select("n", "source", "target").join(known("source"), "source", "left").join(known("target"), "target", "left")
    moving = requests.where("source != target").groupBy(F.col("source").alias("gone")).agg(F.min("n").alias("first"))
    twice = moving.select(F.col("gone").alias("source"), F.col("first").alias("mine"))
    chained = moving.select(F.col("gone").alias("target"), F.lit(True).alias("chain"))
    j = r.join(twice, "source", "left").join(chained, "target", "left")
    reason = F.when(F.col("has_source").isNull() | F.col("has_target").isNull(), F.lit("marker not found")).when(F.col("source") == F.col("target"), F.lit("nothing to do"))
    reason = reason.when(F.col("n") != F.col("mine"), F.lit("source is merged twice")).when(F.col("chain"), F.lit("target is merged itself")).otherwise(F.lit("merged"))
    code = F.when(F.col("reason") == "marker not found", 404).when(F.col("reason").isin("merged", "nothing to do"), 200).otherwise(409)
    return j.withColumn("reason", reason).select("n", "source", "target", code.alias("code"), "reason")


def merge(tables: Tables, requests: DataFrame) -> tuple[Tables, DataFrame]:
    """Rows go over to the target; of tags, alias keys and insights that both have the target's stays, then
    the first request's; the source is no more. Returns the tables and the results."""
    results = merge_results(tables.types, requests)
    moves = results.where("reason = 'merged'").select(F.col("source").alias("__from"), F.col("target").alias("__to"), F.col("n").alias("__n"))

    def moved(df: DataFrame) -> DataFrame:
        j = df.join(moves, df["type_id"] == F.col("__from"), "left")
        return j.withColumn("type_id", F.coalesce("__to", "type_id"))

    own_first = [F.asc_nulls_first("__n")]
    keyed = lambda df, *k: first_of_each(moved(df), ["type_id", *k], own_first).select(*df.columns)
    return (
        Tables(
            types=tables.types.join(moves, tables.types["type_id"] == F.col("__from"), "left_anti"),
            aliases=keyed(tables.aliases, "alias_key"),
            rows=moved(tables.rows).select(*tables.rows.columns),
            tags=keyed(tables.tags, "tag"),
            insights=keyed(tables.insights),
        ),
        results,
    )


def resolved(names: DataFrame, tables: Tables, name: str, out: str) -> DataFrame:
    """names with out: the type of that very name, else of its alias key."""
    exact = tables.types.select(F.col("name").alias("__name"), F.col("type_id").alias("__exact"))
    alias = tables.aliases.select(F.col("alias_key").alias("__key"), F.col("type_id").alias("__alias"))
    j = names.join(shuffled(exact), F.col(name) == F.col("__name"), "left").join(shuffled(alias), K.alias_key(F.col(name)) == F.col("__key"), "left")
    return j.withColumn(out, F.coalesce("__exact", "__alias")).drop("__name", "__exact", "__key", "__alias")


def rename_results(tables: Tables, requests: DataFrame) -> DataFrame:
    """requests: n, name, new_name (null: no name, which is refused). n, type_id, old_name, new_name, code,
    reason: 404 for an unknown name, 400 without a new one, 409 for the name of another marker, for a
    name that an earlier request takes, or for a second request of one marker."""
    found = resolved(resolved(requests.select("n", "name", "new_name"), tables, "name", "type_id"), tables, "new_name", "other")
    j = found.join(shuffled(tables.types.select("type_id", F.col("name").alias("old_name"))), "type_id", "left")
    reason = F.when(F.col("type_id").isNull(), F.lit("marker not found")).when(F.col("new_name").isNull(), F.lit("name is required")).when(F.col("new_name") == F.col("old_name"), F.lit("nothing to do"))
    j = j.withColumn("reason", reason.when(F.col("other").isNotNull() & (F.col("other") != F.col("type_id")), F.lit("name exists")))
    free = F.when(F.col("reason").isNull(), F.col("n"))
    j = j.withColumns({"__name": F.min(free).over(Window.partitionBy("new_name")), "__mine": F.min(free).over(Window.partitionBy("type_id"))})
    last = F.when(F.col("n") != F.col("__name"), F.lit("name exists")).when(F.col("n") != F.col("__mine"), F.lit("marker is renamed already")).otherwise(F.lit("renamed"))
    j = j.withColumn("reason", F.coalesce("reason", last))
    code = F.when(F.col("reason") == "marker not found", 404).when(F.col("reason") == "name is required", 400).when(F.col("reason").isin("renamed", "nothing to do"), 200).otherwise(409)
    return j.select("n", "type_id", "old_name", "new_name", code.alias("code"), "reason")


def rename(tables: Tables, requests: DataFrame) -> tuple[Tables, DataFrame, DataFrame]:
    """New names; the old one and the new become aliases, taking over any alias of their key; insights of renamed
    markers are void. Returns the tables, the results and the files (file_id) to be indexed again."""
    results = rename_results(tables, requests)
    done = results.where("reason = 'renamed'").select("type_id", F.col("old_name").alias("__old"), F.col("new_name").alias("__new"))
    types = tables.types.join(done, "type_id", "left")
    types = types.withColumns({"name": F.coalesce("__new", "name"), "key": F.when(F.col("__new").isNotNull(), K.alias_key(F.col("__new"))).otherwise(F.col("key"))}).select(*tables.types.columns)
    names = done.select("type_id", F.posexplode(F.array("__old", "__new")).alias("__place", "__name"))
    fresh = names.select(K.alias_key(F.col("__name")).alias("alias_key"), K.strip(F.col("__name")).alias("alias_name"), "type_id", "__place").where("alias_key != '' and alias_name != ''")
    fresh = first_of_each(fresh, ["alias_key"], [F.col("__place"), F.col("type_id")]).select("alias_key", "alias_name", "type_id")
    aliases = tables.aliases.join(fresh.select("alias_key"), "alias_key", "left_anti").select("alias_key", "alias_name", "type_id").unionByName(fresh)
    again = tables.rows.join(done.select("type_id"), "type_id", "left_semi").select("file_id").distinct()
    return replace(tables, types=types, aliases=aliases, insights=tables.insights.join(done.select("type_id"), "type_id", "left_anti")), results, again


def broken_keys(tables: Tables) -> DataFrame:
    """What breaks a key: its name and value. Nothing, after merge() and rename() of tables that were whole."""
    twice = lambda df, what, *k: df.groupBy(*k).count().where("count > 1").select(F.lit(what).alias("key"), F.concat_ws("|", *k).alias("value"))
    lost = lambda df, what: df.join(tables.types.select("type_id"), "type_id", "left_anti").where("type_id is not null").select(F.lit(what).alias("key"), F.col("type_id").cast("string").alias("value")).distinct()
    out = twice(tables.types, "type", "type_id")
    for part in (twice(tables.types, "name", "name"), twice(tables.aliases, "alias", "alias_key"), twice(tables.tags, "tag", "type_id", "tag"), twice(tables.insights, "insight", "type_id"), lost(tables.aliases, "alias of no type"), lost(tables.rows, "row of no type"), lost(tables.tags, "tag of no type"), lost(tables.insights, "insight of no type")):
        out = out.unionByName(part)
    return out
