"""Learned rules applied to raw results: names, units, words; and results far off their history.

Rule tables are dimensions; Spark broadcasts them while they are small and joins by shuffle
when they are not, so no hint is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titerloom.functions import keys as K
from titerloom.functions import numbers as N
from titerloom.functions import status as S


def latest_rules(rules: DataFrame, key: list[str], order: str, last_wins: bool = True) -> DataFrame:
    """One rule a key; of several the last (unit and word rules) or the first (names)."""
    rest = [c for c in rules.columns if c not in key]
    pick = F.max_by if last_wins else F.min_by
    return rules.groupBy(*key).agg(pick(F.struct(*rest), F.col(order)).alias("r")).select(*key, "r.*")


def missing_conversion(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (type_id, original_value, effective_original_unit, effective_canonical_unit, overridden)
    with conversion_missing: two different units and no rule, or one without a factor."""
    keyed = rows.withColumns({"__o": K.unit_key(F.col("effective_original_unit")), "__c": K.unit_key(F.col("effective_canonical_unit"))})
    known = rules.select(F.col("type_id").alias("__t"), F.col("original_key").alias("__ro"), F.col("canonical_key").alias("__rc"), "factor")
    joined = keyed.join(known, (keyed["type_id"] == F.col("__t")) & (keyed["__o"] == F.col("__ro")) & (keyed["__c"] == F.col("__rc")), "left")
    missing = F.col("original_value").isNotNull() & F.col("type_id").isNotNull() & ~F.col("overridden") & F.col("__o").isNotNull() & F.col("__c").isNotNull() & (F.col("__o") != F.col("__c")) & F.col("factor").isNull()
    return joined.withColumn("conversion_missing", F.coalesce(missing, F.lit(False))).select(*rows.columns, "conversion_missing")


def apply_rules(rows: DataFrame, types: DataFrame, aliases: DataFrame, unit_rules: DataFrame, word_rules: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The ladder of known rules over raw results.

    rows: id, raw_name, original_value, original_text, original_unit, original_low, original_high.
    types: type_id, type_name, group_name, canonical_unit. aliases: alias_key, type_id.
    unit_rules: type_id, original_key, canonical_key, factor. word_rules: word_key, word, flag.
    failed: task (as in needs) of external requests that were given up.

    Adds type_id, canonical_value/low/high/unit, qualitative_value/flag, status
    (resolved, pending, error), needs (tasks wanted) and check_anomaly.
    """
    r = rows.withColumns({"__name": K.alias_key(F.col("raw_name")), "__unit": K.unit_key(F.col("original_unit")), "__word": K.qualitative_key(F.col("original_text"))})
    r = r.join(aliases.select(F.col("alias_key").alias("__a"), "type_id"), F.col("__name") == F.col("__a"), "left")
    r = r.join(types.select(F.col("type_id").alias("__ti"), "group_name", F.col("canonical_unit").alias("__cu")), F.col("type_id") == F.col("__ti"), "left").withColumn("__ck", K.unit_key(F.col("__cu")))
    ur = unit_rules.select(F.col("type_id").alias("__ut"), F.col("original_key").alias("__uo"), F.col("canonical_key").alias("__uc"), "factor", F.lit(True).alias("__has_rule"))
    r = r.join(ur, (F.col("type_id") == F.col("__ut")) & (F.col("__unit") == F.col("__uo")) & (F.col("__ck") == F.col("__uc")), "left")
    wr = word_rules.select(F.col("word_key").alias("__wk"), F.col("word").alias("__w"), F.col("flag").alias("__wf"), F.lit(True).alias("__has_word"))
    r = r.join(wr, F.col("__word") == F.col("__wk"), "left")

    value, low, high = F.col("original_value"), F.col("original_low"), F.col("original_high")
    untyped = F.col("type_id").isNull()
    numeric, worded = value.isNotNull(), value.isNull() & F.col("original_text").isNotNull()
    has_unit = F.trim(F.coalesce("original_unit", F.lit(""))) != ""
    no_target = has_unit & F.col("__cu").isNull()
    same = ~has_unit | F.col("__cu").isNull() | F.coalesce(F.col("__unit") == F.col("__ck"), F.lit(False))
    ruled = F.coalesce("__has_rule", F.lit(False))
    dead_rule = numeric & ~same & ruled & F.col("factor").isNull()
    factor = F.when(same, F.lit(1.0)).when(ruled, F.col("factor"))
    r = r.withColumn("__hit", S.threshold_result(F.col("original_text"), low, high))
    hit = F.col("__hit")
    has_word = F.coalesce("__has_word", F.lit(False))

    need_unit = ~untyped & numeric & no_target
    need_rule = ~untyped & numeric & ~no_target & ~same & F.col("__unit").isNotNull() & ~ruled
    need_word = ~untyped & worded & hit.isNull() & F.col("__word").isNotNull() & ~has_word
    bad_key = ~untyped & ((numeric & ~no_target & ~same & F.col("__unit").isNull()) | (worded & hit.isNull() & F.col("__word").isNull()))
    tasks = F.array(
        F.when(untyped, F.concat(F.lit("marker:"), "__name")),
        F.when(~untyped & F.col("group_name").isNull(), F.concat(F.lit("group:"), F.col("type_id").cast("string"))),
        F.when(need_unit, F.concat(F.lit("unit:"), F.col("type_id").cast("string"))),
        F.when(need_rule, F.concat(F.lit("conversion:"), K.rule_task_key(F.col("type_id"), F.col("__unit"), F.col("__ck")))),
        F.when(need_word, F.concat(F.lit("word:"), "__word")),
    )
    r = r.withColumn("needs", F.filter(tasks, lambda t: t.isNotNull()))
    if failed is not None:
        gone = r.select("id", F.explode("needs").alias("task")).join(failed.select("task").distinct(), "task", "left_semi").select(F.col("id").alias("__gone")).distinct()
        r = r.join(gone, r["id"] == F.col("__gone"), "left").withColumn("__failed", F.col("__gone").isNotNull())
    else:
        r = r.withColumn("__failed", F.lit(False))
    done = numeric & (same | (ruled & F.col("factor").isNotNull())) & ~no_target
    status = F.when(~untyped & dead_rule, F.lit("resolved")).when(F.col("__failed") | bad_key, F.lit("error")).when(F.size("needs") > 0, F.lit("pending")).otherwise(F.lit("resolved"))
    copied = worded & (hit.isNotNull()) | (value.isNull() & F.col("original_text").isNull())

    def bound(b: Column) -> Column:
        return F.when(untyped, F.lit(None)).when(done, b * factor).when(copied, b)

    return r.select(
        *rows.columns,
        "type_id",
        F.when(~untyped & done, value * factor).alias("canonical_value"),
        bound(low).alias("canonical_low"),
        bound(high).alias("canonical_high"),
        F.when(~untyped & numeric, F.col("__cu")).alias("canonical_unit"),
        F.when(~untyped & worded, F.coalesce(hit["text"], F.when(has_word, F.col("__w")))).alias("qualitative_value"),
        F.when(~untyped & worded, F.when(hit.isNotNull(), hit["flag"]).when(has_word, F.col("__wf"))).alias("qualitative_flag"),
        status.alias("status"),
        "needs",
        (~untyped & done & (status == "resolved")).alias("check_anomaly"),
    )


def anomaly_candidates(rows: DataFrame, envelopes: DataFrame) -> DataFrame:
    """rows: id, marker, file_id, value, low, high; envelopes: as of history.envelopes_without_own_file.

    Adds outlier, candidates (factors that bring the value home) and factor, the one to apply
    at once because its bounds fit too. Without factor an outlier with candidates awaits review."""
    e = envelopes.select("marker", "file_id", *[F.col(c).alias(f"e_{c}") for c in envelopes.columns if c not in ("marker", "file_id")])
    j = rows.join(e, ["marker", "file_id"], "left")
    c = lambda n: F.col(f"e_{n}")
    stable = (c("value_count") >= 2) & (c("file_count") >= 2) & (N.positive_ratio(c("value_min"), c("value_max")) < 10)
    tight = F.coalesce((c("low_count") >= 2) & (c("high_count") >= 2) & (N.positive_ratio(c("low_min"), c("low_max")) < 10) & (N.positive_ratio(c("high_min"), c("high_max")) < 10), F.lit(False))
    off = N.far_outside(F.col("value"), c("value_min"), c("value_max")) | (tight & (N.far_outside(F.col("low"), c("low_min"), c("low_max")) | N.far_outside(F.col("high"), c("high_min"), c("high_max"))))
    outlier = F.coalesce(stable & off, F.lit(False))
    scales = F.array(*map(F.lit, N.SCALES))
    fits = F.filter(scales, lambda f: N.within(F.col("value") * f, c("value_min"), c("value_max")))
    j = j.withColumn("outlier", outlier).withColumn("candidates", F.when(F.col("outlier"), fits).otherwise(F.array().cast("array<double>")))
    bounds = F.filter("candidates", lambda f: N.within(F.col("low") * f, c("low_min"), c("low_max")) & N.within(F.col("high") * f, c("high_min"), c("high_max")))
    return j.withColumn("factor", F.when(tight & (F.size(bounds) == 1), F.element_at(bounds, 1))).select(*rows.columns, "outlier", "candidates", "factor")


def ascii_json(text: Column) -> Column:
    """A text as JSON writes it in ASCII; null as null."""
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    units = lambda c: F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(.{4})", r"\\u$1"))
    each = F.array_join(F.transform(F.split(quoted, ""), lambda c: F.when(F.octet_length(c) == 1, c).otherwise(units(c))), "")
    return F.when(text.isNull(), F.lit("null")).when(F.char_length(quoted) == F.octet_length(quoted), quoted).otherwise(each)


#: Columns of an envelope and what a review's signature calls them.
SIGNED = {
    "value_min": "historical_value_min", "value_max": "historical_value_max", "low_min": "historical_reference_low_min",
    "low_max": "historical_reference_low_max", "high_min": "historical_reference_high_min", "high_max": "historical_reference_high_max",
}


def review_signature(rows: DataFrame, envelopes: DataFrame) -> DataFrame:
    """rows (of anomaly_candidates(), with unit if known) with signature: what a review of a value depends
    on, its number and bounds, the history without its own file, and the candidate factors."""
    e = envelopes.select("marker", "file_id", *[F.col(c).alias(f"e_{c}") for c in envelopes.columns if c not in ("marker", "file_id")])
    j = rows.join(e, ["marker", "file_id"], "left")
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    number = lambda x: F.coalesce(F.concat(F.lit('"'), N.general_number(finite(x), 12), F.lit('"')), F.lit("null"))
    count = lambda x: F.coalesce(x, F.lit(0)).cast("string")
    unit = F.col("unit") if "unit" in rows.columns else F.lit(None).cast("string")
    parts = {
        "candidate_factors": F.concat(F.lit("["), F.array_join(F.transform("candidates", number), ", "), F.lit("]")),
        "canonical_unit": ascii_json(unit),
        "canonical_value": number(F.col("value")),
        "reference_low": number(F.col("low")),
        "reference_high": number(F.col("high")),
        "history_sample_count": count(F.col("e_value_count")),
        "history_range_count": count(F.least(F.coalesce("e_low_count", F.lit(0)), F.coalesce("e_high_count", F.lit(0)))),
    } | {name: number(F.col(f"e_{c}")) for c, name in SIGNED.items()}
    text = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), parts[k]) for k in sorted(parts)]), F.lit("}"))
    return j.select(*rows.columns, F.sha1(text.cast("binary")).alias("signature"))


def apply_reviews(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """rows with outlier, candidates, factor and signature (review_signature()); reviews: id, signature,
    state, factor. A resolved review with the row's signature decides (no factor: keep); a failed one is
    an error."""
    r = reviews.select(F.col("id").alias("__i"), F.col("signature").alias("__s"), "state", F.col("factor").alias("__f"))
    j = rows.join(r, (F.col("id") == F.col("__i")) & (F.col("signature") == F.col("__s")), "left")
    open_ = F.col("outlier") & (F.size("candidates") > 0) & F.col("factor").isNull()
    status = F.when(~open_ | (F.col("state") == "resolved"), F.lit("resolved")).when(F.col("state").isin("failed", "cancelled"), F.lit("error")).otherwise(F.lit("pending"))
    used = F.coalesce("factor", F.when(open_ & (F.col("state") == "resolved"), F.col("__f")), F.lit(1.0))
    return j.withColumns({"status": status, "value": F.col("value") * used, "low": F.col("low") * used, "high": F.col("high") * used}).select(*rows.columns, "status")


def recanonicalise(rows: DataFrame, new_units: DataFrame, rules: DataFrame) -> DataFrame:
    """After a marker's unit changed. rows: id, type_id, original_value, original_unit, original_low,
    original_high, canonical_unit. new_units: type_id, new_unit. Values come from the original
    unit; bounds too if an original bound exists, else they are in the former unit. No rule: nulls."""
    j = rows.join(new_units, "type_id")
    own_bound = F.col("original_low").isNotNull() | F.col("original_high").isNotNull()
    j = j.withColumns({"__v": K.unit_key(F.col("original_unit")), "__n": K.unit_key(F.col("new_unit"))}).withColumn("__b", F.when(own_bound, F.col("__v")).otherwise(K.unit_key(F.col("canonical_unit"))))
    for side in ("v", "b"):
        known = rules.select(F.col("type_id").alias("__t"), F.col("original_key").alias("__o"), F.col("canonical_key").alias("__c"), F.col("factor").alias(f"__f{side}"))
        j = j.join(known, (F.col("type_id") == F.col("__t")) & (F.col(f"__{side}") == F.col("__o")) & (F.col("__n") == F.col("__c")), "left").drop("__t", "__o", "__c")
    factor = lambda s: F.when(F.col(f"__{s}").isNull() | F.coalesce(F.col(f"__{s}") == F.col("__n"), F.lit(False)), F.lit(1.0)).otherwise(F.col(f"__f{s}"))
    return j.select(
        *[c for c in rows.columns if c != "canonical_unit"],
        F.col("new_unit").alias("canonical_unit"),
        (F.col("original_value") * factor("v")).alias("canonical_value"),
        (F.col("original_low") * factor("b")).alias("canonical_low"),
        (F.col("original_high") * factor("b")).alias("canonical_high"),
    )


def guide_rules(requests: DataFrame, rules: DataFrame, n: int = 3) -> DataFrame:
    """For each request (type_id, original_key, canonical_key) up to n rules of other types for the
    same pair of units, by rule id."""
    asked = requests.select("type_id", "original_key", "canonical_key").distinct()
    g = rules.where(F.col("factor").isNotNull()).select(F.col("id").alias("rule_id"), F.col("type_id").alias("guide_type"), "original_key", "canonical_key", "factor").where("guide_type is not null")
    # Of a pair's rules only the first n of a type, and of these the first 2 n, can be among the first n of other types.
    pair = ["original_key", "canonical_key"]
    for k, w in ((n, Window.partitionBy(*pair, "guide_type")), (2 * n, Window.partitionBy(*pair))):
        g = g.withColumn("nth", F.row_number().over(w.orderBy("rule_id", "guide_type"))).where(F.col("nth") <= k).drop("nth")
    few = g.groupBy(*pair).agg(F.sort_array(F.collect_list(F.struct("rule_id", "guide_type", "factor"))).alias("guides"))
    mine = F.slice(F.filter("guides", lambda x: x["guide_type"] != F.col("type_id")), 1, n)
    found = asked.join(few, pair).select(*pair, "type_id", F.posexplode(mine).alias("rn", "g"))
    return found.select(*pair, "type_id", "g.rule_id", "g.guide_type", "g.factor", (F.col("rn") + 1).alias("rn"))


def marker_lookup(names: DataFrame, types: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (name) with type_id by exact name first, else by alias key."""
    exact = types.select(F.col("type_name").alias("__n"), F.col("type_id").alias("__e"))
    alias = aliases.select(F.col("alias_key").alias("__k"), F.col("type_id").alias("__a"))
    return names.join(exact, names["name"] == F.col("__n"), "left").join(alias, K.lookup_key(names["name"]) == F.col("__k"), "left").select(*names.columns, F.coalesce("__e", "__a").alias("type_id"))


def canonical_units(observations: DataFrame) -> DataFrame:
    """type_id, existing_unit, unit rows -> the unit to use and whether no judgement is needed."""
    g = observations.withColumn("key", K.unit_key(F.col("unit"))).groupBy("type_id").agg(
        F.max("existing_unit").alias("existing"), F.collect_set("key").alias("keys"), F.min_by(K.strip(F.col("unit")), F.when(F.col("key").isNotNull(), F.col("id"))).alias("first")
    )
    kept = K.unit_key(F.col("existing"))
    skip = F.when(kept.isNotNull(), F.size(F.array_except("keys", F.array(kept))) == 0).when(F.size("keys") == 0, F.lit(True)).when(F.size("keys") > 1, F.lit(False)).otherwise(~N.needs_judgement(F.element_at("keys", 1)))
    return g.select("type_id", F.coalesce("existing", "first").alias("unit"), skip.alias("settled"))


def merge_types(rows: DataFrame, source: int, target: int, key: list[str], order: str) -> DataFrame:
    """Rows of one type re-keyed to another; of rows that then share a key the first stays."""
    moved = rows.withColumn("type_id", F.when(F.col("type_id") == source, F.lit(target)).otherwise(F.col("type_id")))
    return latest_rules(moved, key, order, last_wins=False) if key else moved
