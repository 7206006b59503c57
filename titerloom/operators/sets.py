"""Upserts, queue transitions, selections and other row-set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str, last_wins: bool = True) -> DataFrame:
    """old with new's rows put over it by key; of new rows that share a key the last (or first)
    by `order` counts. The result has old's columns."""
    rest = [c for c in old.columns if c not in key]
    pick = F.max_by if last_wins else F.min_by
    one = new.groupBy(*key).agg(pick(F.struct(*rest), F.col(order)).alias("r")).select(*key, "r.*").select(*old.columns)
    return old.join(one, key, "left_anti").unionByName(one)


def insert_missing(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """old, plus new's first row of each key that old lacks."""
    rest = [c for c in old.columns if c not in key]
    one = new.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*key, "r.*").select(*old.columns)
    return old.unionByName(one.join(old, key, "left_anti"))


def delete_cascade(parents: DataFrame, children: dict[str, DataFrame], gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents without those gone, and every child table without their rows."""
    ids = gone.select(F.col(key))
    out = {n: c.join(ids.withColumnRenamed(key, foreign), foreign, "left_anti").select(*c.columns) for n, c in children.items()}
    return parents.join(ids, key, "left_anti").select(*parents.columns), out


def claimable(now: Column) -> Column:
    """Jobs a worker may take: due, and waiting or with a lease that ran out."""
    return (F.col("available_at") <= now) & ((F.col("status") == "pending") | ((F.col("status") == "leased") & (F.col("lease_until") < now)))


def claim(jobs: DataFrame, now: Column, n: int) -> DataFrame:
    """The n jobs to take next: by priority, age and id."""
    return jobs.where(claimable(now)).orderBy("priority", "created_at", "id").limit(n)


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """jobs after wanted tasks (task_type, task_key): a leased job is marked for another run, any
    other is pending again, a new one is added. Asking twice changes nothing more."""
    asked = wanted.select("task_type", "task_key").distinct().withColumn("__asked", F.lit(True))
    j = jobs.join(asked, ["task_type", "task_key"], "left")
    hit, leased = F.coalesce("__asked", F.lit(False)), F.col("status") == "leased"
    kept = j.withColumns({"rerun_requested": F.when(hit & leased, F.lit(True)).otherwise(F.col("rerun_requested")), "status": F.when(hit & ~leased, F.lit("pending")).otherwise(F.col("status"))}).select(*jobs.columns)
    new = asked.join(jobs, ["task_type", "task_key"], "left_anti").withColumns({"status": F.lit("pending"), "rerun_requested": F.lit(False)})
    return kept.unionByName(new.select("task_type", "task_key", "status", "rerun_requested"), allowMissingColumns=True)


def prune(jobs: DataFrame, now: Column) -> DataFrame:
    """Old finished jobs go; leases of a former run are given back with their attempts."""
    age = lambda h: F.col("updated_at") < now - F.make_dt_interval(hours=F.lit(h))
    gone = ((F.col("status") == "resolved") & age(6)) | (F.col("status").isin("failed", "cancelled") & age(48))
    leased = F.col("status") == "leased"
    fresh = {"attempt_count": F.lit(0), "status": F.lit("pending"), "lease_owner": F.lit(None), "lease_until": F.lit(None), "error_text": F.lit(None), "updated_at": now}
    return jobs.where(~gone).withColumns({c: F.when(leased, v).otherwise(F.col(c)) for c, v in fresh.items() if c in jobs.columns})


def after_failure(jobs: DataFrame, now: Column, most: int = 3, wait_s: int = 15) -> DataFrame:
    """Jobs whose attempt failed: due again after a wait, or failed for good."""
    again = F.col("attempt_count") < most
    return jobs.withColumns({"status": F.when(again, F.lit("pending")).otherwise(F.lit("failed")), "available_at": F.when(again, now + F.make_dt_interval(secs=F.lit(wait_s))).otherwise(F.col("available_at"))})


def failure_kind(text: Column, kind: Column | None = None) -> Column:
    """Why a request for pages failed, by what the error says; kind: the error's class, which names all others."""
    says = lambda words: F.contains(F.lower(text), F.lit(words))
    timeout, limited, large = says("timeout") & says("session.idle"), says("429") | says("rate limit") | says("too many requests"), says("413") | says("failed to parse request")
    other = F.lit("Exception") if kind is None else kind
    timeout = timeout if kind is None else timeout | (kind == "TimeoutError")
    return F.when(timeout, F.lit("timeout")).when(limited, F.lit("rate-limit")).when(large, F.lit("request-too-large")).otherwise(other)


def splits(kind: Column) -> Column:
    """Whether a failure of this kind is tried again with fewer pages."""
    return kind.isin("timeout", "rate-limit", "request-too-large")


def has_all_tags(tags: DataFrame, owner: str, wanted: list[str]) -> DataFrame:
    """Owners that bear every wanted tag: one aggregation, however many tags are asked for."""
    ask = list(dict.fromkeys(wanted))
    found = tags.where(F.col("tag").isin(ask)).select(owner, "tag").distinct().groupBy(owner).agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") == len(ask)).select(owner)


def first_seen(rows: DataFrame, group: list[str], value: Column, order: list[Column], most: int) -> DataFrame:
    """Up to `most` distinct values of each group, in order of first appearance. The aggregation
    below the window leaves one row a value, and the row limit is pushed under the shuffle."""
    firsts = rows.withColumn("__v", value).where(F.col("__v").isNotNull()).groupBy(*group, "__v").agg(F.min(F.struct(*order)).alias("__at"))
    ranked = firsts.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy("__at"))).where(F.col("rn") <= most)
    return ranked.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "__v"))), lambda s: s["__v"]).alias("values"))


def first_rows(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rn") <= n)


def chunks(rows: DataFrame, order: list[Column], size: int, group: list[str]) -> DataFrame:
    """rows with chunk, the number of the fixed-size batch they fall in within their group."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / size).cast("int"))


def added_up(facts: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Usage counters: what is not positive doesn't count."""
    return facts.groupBy(*by).agg(F.sum(F.when(F.col(amount) > 0, F.col(amount))).alias(amount))
