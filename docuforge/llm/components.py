"""Connected components of an edge table, without collecting links or components to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuforge.llm.common import Scratch


def _flat(root: np.ndarray) -> np.ndarray:
    while (up := root[root]).tolist() != root.tolist():
        root = up
    return root


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by minimum, in place, vectorised: repeats until every pair shares a root."""
    while len(a):
        flat = _flat(root)
        root[:] = flat
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))


#: Links that a task joins at a time.
HELD_LINKS = 1 << 20


def _contract(batches):
    """Links that join what the links of the task join: each node to the smallest it is joined with."""

    def forest(held):
        ends = np.concatenate([np.concatenate(x) for x in zip(*held)])
        nodes, at = np.unique(ends, return_inverse=True)
        root = np.arange(len(nodes))
        _unite(root, at[: len(at) // 2], at[len(at) // 2 :])
        root = _flat(root)
        child = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], names=["hi", "lo"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
        if n >= HELD_LINKS:
            yield forest(held)
            held, n = [], 0
    if held:
        yield forest(held)


#: Components broadcast at most, and the size up to which a component is not hot.
HOT_COMPONENTS, HOT_ROWS = 1_000_000, 256


def with_least(rows: DataFrame, scratch: Scratch, least: str, name: str) -> DataFrame:
    """``rows``, a written table, with ``name``: the smallest ``least`` of their ``component``.

    Minima combine on the map side.  Components of more than ``HOT_ROWS`` rows, and of more than the
    ``HOT_COMPONENTS``-th part of all rows, get theirs by a broadcast, which so many at most can need; no
    task gathers a giant component.  Null components keep their rows, with a null.
    """
    tops = scratch.table(rows.groupBy(F.col("component").alias("_c")).agg(F.min(least).alias(name), F.count("*").alias("_n")), "tops", rows.count())
    n = tops.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = F.col("_n") > max(HOT_ROWS, n // HOT_COMPONENTS)
    known = F.broadcast(tops.where(hot).select("_c", F.col(name).alias("_known"), F.lit(True).alias("_hot")))
    rows = rows.join(known, rows["component"] == known["_c"], "left").drop("_c")
    big = rows.where("_hot").select(*[c for c in rows.columns if c not in ("_known", "_hot")], F.col("_known").alias(name))
    rest = rows.where("_hot is null").drop("_known", "_hot")
    rest = rest.join(tops.where(~hot).select("_c", name), rest["component"] == F.col("_c"), "left").drop("_c")
    return big.unionByName(rest)


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable by links, for every node that has a link.

    Alternates the public large-star and small-star steps.  Each step is one
    aggregation to a minimum per node, which combines on the map side, and one
    join, which AQE can split where a node is a hub.  Edges are written to the
    shared folder after each round and the number of rounds grows with the
    logarithm of the largest component.
    Nodes are integers.  Nulls: edges with a null end are dropped.  Loops and repeated edges do no harm.
    """
    e = edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"), (F.col(src).isNotNull() & F.col(dst).isNotNull()).alias("ok"))
    # Repeated links, and links that a node has to many of one component, shrink to one before the first round.
    e = e.where("ok and hi <> lo").select(F.col("hi").cast("long").alias("hi"), F.col("lo").cast("long").alias("lo"))
    e = scratch.table(e.repartition("hi").mapInArrow(_contract, "hi bigint, lo bigint"), "cc-0")
    step = 0
    while True:
        # Large star: every node's larger neighbours move to the smallest node of its neighbourhood.
        least = e.groupBy("hi").agg(F.min("lo").alias("low"))
        large = (
            e.join(least.withColumnRenamed("hi", "lo"), "lo", "left")
            .select("hi", F.coalesce("low", "lo").alias("lo"))
        )
        large = large.where("hi <> lo").distinct()
        # Small star: every node's smaller neighbours, and the node itself, move to the smallest of them.
        small = large.groupBy("hi").agg(F.min("lo").alias("low"))
        after = large.join(small, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("low")), F.struct(F.col("lo").alias("hi"), F.col("low")))).alias("x")).select("x.*")
        after = after.where("hi <> low").select("hi", F.col("low").alias("lo")).distinct()
        step += 1
        after = scratch.table(after, f"cc-{step}", 2 * e.count())
        # Done when no node has two parents and no parent has a parent.
        pending = after.groupBy("hi").count().where("count > 1").limit(1).count() or after.join(after.select(F.col("hi").alias("p")), F.col("lo") == F.col("p"), "left_semi").limit(1).count()
        scratch.drop(f"cc-{step - 1}")
        e = after
        if not pending:
            roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
