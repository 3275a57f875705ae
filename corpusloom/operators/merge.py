"""Keyed changes to tables: inserts, partial updates, upserts, deletes, expiry, violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _match(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return out


def _keyed(keys: list[str]) -> Column:
    """A key with a null in it names no row."""
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"o.{k}") == F.col(f"n.{k}")
    return out


def latest(changes: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One change for each key: the last by order. A partial update needs this first."""
    return changes.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(order.desc()))).where("_rn = 1").drop("_rn")


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table lacks."""
    return rows.alias("n").join(table.select(*keys).distinct().alias("o"), _match(keys), "left_anti")


def partial_update(table: DataFrame, changes: DataFrame, keys: list[str], merged: tuple[str, ...] = ()) -> DataFrame:
    """table with the columns that changes has: null keeps the old value, map columns in `merged` are merged, new keys winning.

    Changes must be unique by key; rows and changes with a null in their key meet none.
    """
    x = table.alias("o").join(changes.alias("n"), _keyed(keys), "left")

    def column(c: str) -> Column:
        if c in keys or c not in changes.columns:
            return F.col(f"o.{c}")
        if c in merged:
            return map_merge(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
        return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)

    return x.select(*map(column, table.columns))


def map_merge(old: Column, new: Column) -> Column:
    """Shallow merge of two maps, the new one wins; works whatever the session does about equal keys."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """Old rows with the columns in `update` (all by default) taken from rows of the same key, and rows with new keys."""
    update = [c for c in table.columns if c not in keys] if update is None else update
    x = table.alias("o").join(rows.withColumn("_hit", F.lit(True)).alias("n"), _match(keys), "left")
    kept = x.select(*[F.when(F.col("n._hit"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in update else F.col(f"o.{c}") for c in table.columns])
    return kept.unionByName(insert_if_absent(table, rows, keys).select(*table.columns))


def replace(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Delete by key, then insert: rows take the place of all old rows with one of their keys; null keys match each other."""
    kept = table.alias("o").join(rows.select(*keys).distinct().alias("n"), _match(keys), "left_anti")
    return kept.unionByName(rows.select(*table.columns))


def outdated(version: Column, now: str) -> Column:
    """Rows made by another version, or by none that is known."""
    return version.isNull() | (version != now)


def leased(queue: DataFrame, now: str, seconds: int, n: int) -> tuple[DataFrame, DataFrame]:
    """The next n visible messages of queue(msg_id, visible_at, read_count, ...), and the queue in which they are hidden for some seconds.

    A message that is not acknowledged by then becomes visible again.
    """
    at = F.lit(now).cast("timestamp_ntz")
    taken = queue.where(F.col("visible_at") <= at).orderBy("msg_id").limit(n).select(F.col("msg_id").alias("_m"))
    x = queue.join(F.broadcast(taken), F.col("msg_id") == F.col("_m"), "left").withColumn("_t", F.col("_m").isNotNull())
    x = x.withColumn("visible_at", F.when(F.col("_t"), at + F.make_dt_interval(secs=F.lit(seconds))).otherwise(F.col("visible_at")))
    x = x.withColumn("read_count", F.col("read_count") + F.col("_t").cast("int"))
    return x.where("_t").drop("_m", "_t"), x.drop("_m", "_t")


def acknowledged(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue without the messages of done(msg_id)."""
    return queue.join(done.select("msg_id"), "msg_id", "left_anti")


def expire(table: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    return table.where(F.col(at) >= F.date_sub(F.to_date(F.lit(as_of)), days))


def recent(table: DataFrame, at: str, as_of: str, days: int, month: str | None = None) -> DataFrame:
    """Rows of the last days; `month` names a partition column, which then prunes directories."""
    first = F.date_sub(F.to_date(F.lit(as_of)), days)
    x = table.where((F.col(at) >= first) & (F.col(at) < F.date_add(F.to_date(F.lit(as_of)), 1)))
    return x.where(F.col(month) >= F.trunc(first, "MM")) if month else x


def keep_months(table: DataFrame, month: str, as_of: str, months: int = 6) -> DataFrame:
    return table.where(F.col(month) >= F.add_months(F.trunc(F.to_date(F.lit(as_of)), "MM"), -months))


def violations(table: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """key, rule for each broken rule of each row; null results count as kept rules. One pass."""
    broken = F.filter(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]), lambda r: r.isNotNull())
    return table.select(key, F.explode(broken).alias("rule"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child that refer to no row of parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")


def transient(rows: DataFrame, reason: Column, most: int = 3) -> DataFrame:
    """rows after a failure that may pass: attempts + 1; failed after `most`, else pending again."""
    x = rows.withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1)
    over = F.col("attempts") >= most
    return x.withColumn("fail_reason", F.when(over, "max_retries_exceeded").otherwise(reason)).withColumn("status", F.when(over, "failed").otherwise("pending"))


def rerouted(rows: DataFrame, retryable: tuple[str, ...]) -> DataFrame:
    """Failed rows for another try: pending if the reason may pass, enriched if there is a text to judge again."""
    failed = F.col("status") == "failed"
    again = F.when(failed & F.col("fail_reason").isin(*retryable), "pending").when(failed & (F.length("text") >= 500), "enriched").otherwise(F.col("status"))
    return rows.withColumn("status", again)
