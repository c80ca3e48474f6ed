"""Joins that need a plan shape of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

#: Rows of a side that may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a bounded count shows that it is small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def keep_unknown(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left")


def excluding(left: DataFrame, blocked: DataFrame, on) -> DataFrame:
    """Rows of left that match nothing in blocked."""
    return left.join(blocked, on, "left_anti")


def identity_closure(nodes: DataFrame, refs: DataFrame, id_col: str, merged_col: str, ref_col: str) -> DataFrame:
    """refs with canonical: the node that a referred one was merged into, or itself. An equi-join in place of id = ref OR merged = ref."""
    canonical = nodes.select(F.col(id_col).alias("_node"), F.coalesce(merged_col, id_col).alias("canonical"))
    return refs.join(canonical, F.col(ref_col) == F.col("_node"), "left").drop("_node")


def blocked_pairs(df: DataFrame, id_col: str, blocks: list[str]) -> DataFrame:
    """All pairs a < b of rows that agree in the block columns, as columns a_* and b_*.

    Blocks must be selective: a pair is made for every two rows of one.
    """
    a = df.select([F.col(c).alias(f"a_{c}") for c in df.columns])
    b = df.select([F.col(c).alias(f"b_{c}") for c in df.columns])
    on = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in blocks]
    return a.join(b, [*on, F.col(f"a_{id_col}") < F.col(f"b_{id_col}")])


def resolve_by_key(names: DataFrame, registry: DataFrame, name_key: str) -> DataFrame:
    """names with the registry row whose key is equal, the lowest priority and then the lowest order winning.

    registry: key, priority (0 name, 1 alias, 2 room, 3 room alias), ord, venue_id, sub_venue.
    """
    tier = F.when(F.col("priority") < 2, 0).otherwise(1)
    best = registry.groupBy("key").agg(F.min_by(F.struct("venue_id", "sub_venue"), F.struct(tier.alias("t"), "ord", "priority")).alias("v"))
    return names.join(best, F.col(name_key) == F.col("key"), "left").drop("key").select("*", "v.venue_id", "v.sub_venue").drop("v")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is greatest in the order columns; aggregates before it shuffles, so hot keys don't gather."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """DISTINCT ON: the least row of each key, aggregated before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], keep_first: tuple[str, ...] = (), guard: Column | None = None) -> DataFrame:
    """The snapshot after new rows are merged in: unmatched ones of either side stay, matched ones take the new value.

    keep_first: columns whose stored value, if any, stays. guard: over columns
    old.* and new.*, whether a matched row is overwritten at all. new must have
    one row per key; giving it twice changes nothing.
    """
    o, n = stored.alias("old"), new.alias("new")
    matched = F.col("_in_old") & F.col("_in_new")
    write = F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))
    both = o.withColumn("_in_old", F.lit(True)).alias("old").join(n.withColumn("_in_new", F.lit(True)).alias("new"), [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full_outer")
    take_new = F.col("_in_new").isNotNull() & (F.col("_in_old").isNull() | F.coalesce(matched & write, F.lit(False)))
    out = []
    for c in stored.columns:
        old, fresh = F.col(f"old.{c}"), F.col(f"new.{c}")
        fresh = F.coalesce(old, fresh) if c in keep_first else fresh
        out.append(F.when(take_new, fresh).otherwise(old).alias(c))
    return both.select(out)


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored and those rows of new whose key it lacks, each key once."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def set_plan(stored: DataFrame, observed: DataFrame, keys: list[str], value: str, deletes_allowed: Column) -> DataFrame:
    """What turns stored into observed: keys, action (insert, update, delete, suppressed-delete, keep), value."""
    o, n = stored.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_a")), observed.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_b"))
    both = o.join(n, keys, "full_outer")
    gone = F.when(deletes_allowed, "delete").otherwise("suppressed-delete")
    action = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), gone).when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update")
    return both.select(*keys, action.alias("action"), F.coalesce("_new", "_old").alias(value))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key, most at most. Spark keeps no more than those of each key in a task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with rows numbered from 1 in an order: range partitions are sorted on their own, and each starts after the rows of those before.

    One count a partition goes to the driver. The order should be whole (end in a key), so that no value of it is all rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = checkpointed(spread.withColumns({"_part": F.spark_partition_id(), "_at": at.bitwiseAND((1 << 33) - 1)}))
    starts, total = [], 1
    for part, count in sorted(tuple(r) for r in placed.groupBy("_part").count().collect()):
        starts.append((part, total))
        total += count
    before = spark.createDataFrame(starts, "_part int, _before long")
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
