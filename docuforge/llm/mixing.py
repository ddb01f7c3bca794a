"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every row draws an exponential key scaled by its quality weight.  A source's
target is met by whole epochs first; the rest is filled in key order until the
prefix sum of sizes reaches the budget.  The prefix sum is hierarchical: sizes
are summed by coarse and fine key ranges, and rows are ordered only inside the
one fine range in which the budget runs out, so no task orders a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuforge.llm.common import Scratch, free_name, own

#: Key ranges: COARSE ranges of FINE parts each.
COARSE, FINE = 256, 256
#: Weights at which the map of keys to ranges is level; neighbours differ by half at most, down to the least weight.
LEVELS = (1.0, 0.5, 0.25, 0.125, 0.0625, 0.05)
#: Above so many sources the per-source table is joined by a shuffle, with salted sources, instead of broadcast.
BROADCAST_SOURCES = 100_000
SALTS = 64


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """A document's sampling weight from 0.05 to 1: lower the more of its characters are symbols or digits."""
    share = 1 - F.length(F.translate(text, "0123456789|!*%$#@&^~<>{}[]=+_\\", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.coalesce(1 - 4 * share, F.lit(1.0)), F.lit(0.05))


def key_part(key: Column) -> Column:
    """The range of a key: a monotone map that is the mean of the distributions of keys at the weights ``LEVELS``.

    A row of weight w has an exponential key of rate w.  Whatever the weights from 0.05 to 1, the
    rows of one weight fall into any range with at most 12 (levels times two) times the share of an even deal: one
    in 5,461, so no range gathers a source.
    """
    level = sum((1 - F.exp(-key * w) for w in LEVELS), F.lit(0.0)) / len(LEVELS)
    return F.least(F.floor(level * (COARSE * FINE)), F.lit(COARSE * FINE - 1)).cast("int")


def targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float, cap: float) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code point, null last.

    Targets share ``total_share`` of all sizes by weight and stop at ``cap``
    times the source's size; the excess is shared again by weight until no target is above.
    That ends where every target is min(cap * size, level * weight), so the
    level is found directly, over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.select("source", "source_size", cycle.alias("w"), (F.col("source_size") * float(cap)).alias("most"))
    every = Window.partitionBy()
    full = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.select(
        "*",
        (F.sum("source_size").over(every) * float(total_share)).alias("budget"),
        F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("capped"),
        F.sum("w").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open_w"),
    )
    # If this source and all after it are open, the level is as below; the first source whose cap is not under it settles it.
    s = s.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_w"))
    s = s.withColumn("level", F.min(F.when(F.col("most") >= F.col("level") * F.col("w"), F.struct(F.col("most") / F.col("w"), F.col("source"), F.col("level")))).over(every)["level"])
    return s.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))


def _per_source(rows: DataFrame, table: DataFrame, n_sources: int) -> DataFrame:
    """Join rows with a per-source table, null-safe: broadcast where its size is checked, salted otherwise."""
    if n_sources <= BROADCAST_SOURCES:
        table = F.broadcast(table.withColumnRenamed("source", "_source"))
        return rows.join(table, rows["source"].eqNullSafe(table["_source"])).drop("_source")
    salted = table.withColumnRenamed("source", "_source").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_row_salt", F.pmod(F.xxhash64("tie"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, rows["source"].eqNullSafe(salted["_source"]) & (F.col("_row_salt") == F.col("_salt"))).drop("_source", "_salt", "_row_salt")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    total_share: float = 1.5,
    cap: float = 2.0,
    seed: int = 42,
    keep: list[str] | None = None,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row; ``keep`` adds columns of ``docs``.

    A kept column named like one of these five, in any case of letters, comes out with underscores added.  Null and blank texts have size 0 and are taken 0 words.  A null source is a
    source of its own.  Keys come from a hash of id, text and ``seed``, so
    reruns agree; repeated rows tie and stand in for each other.  An
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.col(text_col)
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), text, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(F.col(id_col), text, F.lit(seed + 1)).alias("tie"),
        (-F.log(u) / quality_weight(text)).alias("key"),
        *[own(c).alias(f"_keep_{i}") for i, c in enumerate(keep or [])],
    )
    rows = scratch.table(rows.withColumn("part", key_part(F.col("key"))), "rows")

    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    parts = scratch.table(parts.withColumn("coarse", F.floor(F.col("part") / FINE).cast("int")), "parts")
    coarse = parts.groupBy("source", "coarse").agg(F.sum("part_size").alias("coarse_size"))
    sizes = scratch.table(coarse.groupBy("source").agg(F.sum("coarse_size").alias("source_size")), "sizes")
    n_sources = sizes.count()
    plan = targets(sizes, weights, total_share, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    plan = scratch.table(plan, "plan")

    def reached(table: DataFrame, size: str, within: list[str], order: str, before: str) -> DataFrame:
        """Words before each range, and of the ranges the one in which the budget runs out."""
        w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        table = table.withColumn("_before", F.col(before) + F.coalesce(F.sum(size).over(w), F.lit(0)))
        return table.where((F.col("_before") <= F.col("rest")) & (F.col("_before") + F.col(size) > F.col("rest")))

    c = _per_source(coarse.withColumn("tie", F.col("coarse")), plan.select("source", "rest", F.lit(0).cast("long").alias("zero")), n_sources).drop("tie")
    c = reached(c, "coarse_size", ["source"], "coarse", "zero").select("source", F.col("coarse").alias("edge_coarse"), F.col("_before").alias("coarse_before"), "rest")
    p = _per_source(parts.withColumn("tie", F.col("part")), c, n_sources).where("coarse = edge_coarse").drop("tie")
    p = reached(p, "part_size", ["source"], "part", "coarse_before").select("source", F.col("part").alias("edge"), F.col("_before").alias("edge_before"))
    # A source whose every range fits into the rest has no edge: all its rows are below it.
    edges = plan.withColumnRenamed("source", "_s").join(p, F.col("_s").eqNullSafe(p["source"]), "left").select(F.col("_s").alias("source"), "source_size", "target", "epochs", "rest", F.coalesce("edge", F.lit(COARSE * FINE)).alias("edge"), F.coalesce("edge_before", F.lit(0)).alias("edge_before"))
    rows = _per_source(rows, scratch.table(edges, "edges"), n_sources)

    at_edge = rows.where("part = edge")
    w = Window.partitionBy("source").orderBy("key", "tie", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = at_edge.withColumn("_upto", F.col("edge_before") + F.sum("size").over(w))
    # The row in which the budget runs out is taken if that comes nearer to the budget.
    more_edge = at_edge.withColumn("more", (F.col("_upto") - F.col("size") / 2 <= F.col("rest")).cast("long")).drop("_upto")
    more = rows.where("part <> edge").withColumn("more", (F.col("part") < F.col("edge")).cast("long"))
    used, names = {"doc_id", "size", "source_size", "target", "taken", *(keep or [])}, []
    for i, c in enumerate(keep or []):
        clash = c.lower() in {"doc_id", "size", "source_size", "target", "taken"}
        names.append(F.col(f"_keep_{i}").alias(free_name(c, used) if clash else c))
        used.add(free_name(c, used) if clash else c)
    return more.unionByName(more_edge).select(F.col("doc_id"), "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("more"))).alias("taken"), *names)
