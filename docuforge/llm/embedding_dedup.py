"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), nearest first.  It is
entered, with that permutation, in the inverted lists of its first few pivots.  Of two
vectors that meet in a list the pivots both descriptions hold are counted; pairs
that share enough, at positions close enough, are candidates and are
verified by their exact cosine in double precision.  A pair that meets in several lists counts in
one only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from docuforge.llm.common import Scratch
from docuforge.llm.components import _flat, _unite, connected_components, with_least

#: Rows of a list compared in one task; a longer list is dealt out as pairs of blocks.
BLOCK = 4096
#: Up to so many long lists (24 bytes each) are broadcast; more are joined.
BROADCAST_LISTS = 100_000
#: Pivots are this far apart: reference points closer than the noise of a link would order by chance.
PIVOT_COSINE = 0.8
#: Pivots are at most so many, whatever the table's size, and so many lengths of vectors have pivots from the data.
MOST_PIVOTS, DIMS = 2048, 64


def units(v: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; scaled first, so that no square over- or underflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def apart(sample: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` rows of unit vectors that are no closer to one another than ``PIVOT_COSINE``."""
    kept: list[np.ndarray] = []
    for v in sample:
        if len(kept) == n:
            break
        if not kept or (np.stack(kept) @ v).max() < PIVOT_COSINE:
            kept.append(v)
    return np.stack(kept)


def any_pivots(dim: int, n: int) -> np.ndarray:
    """Pivots in directions fixed by the length alone, for lengths too rare to have their own."""
    return units(np.random.default_rng(dim).normal(size=(n, dim)))


def choose_pivots(vectors: DataFrame, n: int | None, kind) -> dict[int, np.ndarray]:
    """Unit pivots by length of vector, for the ``DIMS`` most frequent lengths.

    ``n`` of each, by default the root of the number of vectors (64 at least, ``MOST_PIVOTS`` at most); the sample they
    are taken from, by a hash of the vector, is bounded by four times that.
    """
    out = {}
    for d, count in vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(DIMS).collect():
        m = n or min(MOST_PIVOTS, max(64, math.isqrt(count)))
        rows = vectors.where(F.col("dim") == d).groupBy("v").agg(F.xxhash64("v").alias("h")).orderBy("h", "v").limit(4 * m).select("v").collect()
        out[d] = apart(units(np.stack([np.frombuffer(r[0], kind) for r in rows])), m)
    return out


def permutations(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first; of equally near ones the smaller number first."""
    return np.argsort(-(units(v) @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)


def _lists(pivots, prefix: int, n_lists: int, kind):
    def run(batches):
        for batch in batches:
            keys, labels, dims, blobs, many = (batch.column(i) for i in range(5))
            d = dims.to_numpy()
            for dim in np.unique(d):
                at = np.flatnonzero(d == dim)
                p = pivots.value.get(int(dim))
                p = any_pivots(int(dim), 64) if p is None else p
                v = np.stack([np.frombuffer(blobs[int(i)].as_py(), kind) for i in at])
                order = permutations(v, p, prefix)
                s, packed = min(n_lists, order.shape[1]), pa.array([x.tobytes() for x in order], pa.binary())
                mine = batch.take(pa.array(at))
                for k in range(s):
                    columns = [pa.array(order[:, k].astype(np.int64)), *(mine.column(c) for c in range(5)), packed]
                    yield pa.RecordBatch.from_arrays(columns, names=["pivot", "key", "label", "dim", "v", "many", "near"])

    return run


def _bits(near: np.ndarray) -> np.ndarray:
    """The pivots of each description as a set of 128 bits: shared bits are never fewer than shared pivots, up to those that fall together."""
    out = np.zeros((len(near), 2), np.uint64)
    for p in near.T:
        out[np.arange(len(near)), (p >> 6) & 1] |= np.uint64(1) << (p & 63).astype(np.uint64)
    return out


def _compare(least: float, n_lists: int, shared: int, shift: int, kind):
    """Per list (or pair of its blocks): how many rows each vector links to, and links that join what is linked."""

    def blocks(pivot, keys, v, near, many, side, diagonal):
        unit, bits, k = units(v), _bits(near), near.shape[1]
        # Pivots whose bits fall together hide one another: so many fewer may show.
        hidden = k - np.bitwise_count(bits).sum(1).astype(np.int64)
        place = np.abs(np.arange(k)[:, None] - np.arange(k)[None]) <= shift
        n_links, root = np.zeros(len(keys), np.int64), np.arange(len(keys))
        left = np.flatnonzero(side == 0)
        right = left if diagonal else np.flatnonzero(side == 1)
        for i in range(0, len(left), 128):
            rows = left[i : i + 128]
            count = np.bitwise_count(bits[rows, None, 0] & bits[None, right, 0]) + np.bitwise_count(bits[rows, None, 1] & bits[None, right, 1])
            near_by = count >= min(shared, k) - np.minimum(hidden[rows, None], hidden[None, right])
            if diagonal:
                near_by &= rows[:, None] < right[None]
            r, c = np.flatnonzero(near_by.any(1)), np.flatnonzero(near_by.any(0))
            if not len(r):
                continue
            x, y = np.nonzero((unit[rows[r]] @ unit[right[c]].T >= least) & near_by[np.ix_(r, c)])
            x, y = rows[r[x]], right[c[y]]
            same = near[x][:, :, None] == near[y][:, None, :]
            enough = (same & place).sum((1, 2)) >= min(shared, k)
            # The list of the smallest pivot that both are entered under.
            first = np.where(same[:, :n_lists, :n_lists].any(2), near[x][:, :n_lists], np.iinfo(np.int32).max).min(1)
            mine = enough & (first == pivot)
            x, y = x[mine], y[mine]
            np.add.at(n_links, x, many[y])
            np.add.at(n_links, y, many[x])
            _unite(root, x, y)
        root = _flat(root)
        child = np.flatnonzero((root != np.arange(len(root))) | (n_links > 0))
        return pa.RecordBatch.from_arrays([pa.array(keys[child]), pa.array(keys[root[child]]), pa.array(n_links[child])], names=["a", "b", "n"])

    def run(batches):
        held, key = [], None

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            if t.num_rows < 2:
                return None
            dim, k = t.column("dim")[0].as_py(), len(t.column("near")[0].as_py()) // 4
            v = np.frombuffer(b"".join(t.column("v").to_pylist()), kind).reshape(-1, dim)
            near = np.frombuffer(b"".join(t.column("near").to_pylist()), np.int32).reshape(-1, k)
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            side = (t.column("mine").to_numpy() != i).astype(int)
            return blocks(t.column("pivot")[0].as_py(), t.column("key").to_numpy(), v, near, t.column("many").to_numpy(), side, i == j)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("label", "dim", "pivot", "i", "j")], 1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
                now = tuple(keys[lo])
                if now != key:
                    if held and (out := flush()) is not None:
                        yield out
                    held, key = [], now
                held.append(batch.slice(lo, hi - lo))
        if held and (out := flush()) is not None:
            yield out

    return run


def embedding_groups(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, n_pivots: int | None = None, prefix: int = 8, n_lists: int = 3, shared: int = 4, shift: int = 4
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows are compared only when their labels are equal and not null and their vectors equally long.
    Vectors that are null, empty, zero or hold null or non-finite parts link with
    nothing: n_links 0, a component of their own.  Equal vectors collapse to one entry that
    counts for all of them, so copies never pair up.  Repeated ids are rows of their own that share
    a component_id.  Ids and labels must be integers.  A pair is found if one of the ``n_lists`` first pivots is the same and
    the first ``prefix`` pivots agree in ``shared`` that stand at most ``shift`` places apart.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "embedding")
    of_floats = isinstance(rows.schema[vector_col].dataType, ArrayType) and isinstance(rows.schema[vector_col].dataType.elementType, FloatType)
    packed = np.float32 if of_floats else np.float64  # as exact as they come
    base = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("e"))
    sound = F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)
    finite = ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0)
    base = base.select("*", F.coalesce(sound & finite, F.lit(False)).alias("sound"))

    def blobs(batches):
        for batch in batches:
            e = batch.column(2)
            v = pa.array([np.asarray(x, packed).tobytes() if (x := y.as_py()) is not None else None for y in e], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(y) if y.is_valid else None for y in e], pa.int32()), v], names=["vec_id", "label", "dim", "v"])

    kind = rows.schema[id_col].dataType.simpleString()
    entries = base.where("sound").select("vec_id", "label", "e").mapInArrow(blobs, f"vec_id {kind}, label bigint, dim int, v binary")
    entries = scratch.table(entries, "entries")
    # A class: equal vectors of one label.  Its key is the smallest of the hashes that tell classes apart, its id the smallest of its rows.
    classes = entries.groupBy("label", "dim", "v").agg(F.count("*").alias("many"), F.min("vec_id").alias("least_id"))
    classes = scratch.table(classes.select("*", F.monotonically_increasing_id().alias("key")), "classes")
    pivots = spark.sparkContext.broadcast(choose_pivots(classes, n_pivots, packed))
    lists = classes.select("key", "label", "dim", "v", "many").mapInArrow(_lists(pivots, prefix, n_lists, packed), "pivot bigint, key bigint, label bigint, dim int, v binary, many bigint, near binary")
    long = lists.groupBy("label", "dim", "pivot").count().where(F.col("count") > BLOCK).select("label", "dim", "pivot", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    long = scratch.table(long, "long")
    long = F.broadcast(long) if long.count() <= BROADCAST_LISTS else long
    dealt = lists.join(long, ["label", "dim", "pivot"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", "pivot", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "key", "many", "v", "near")
    by = ["label", "dim", "pivot", "i", "j"]
    found = dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_compare(least, n_lists, shared, shift, packed), "a bigint, b bigint, n bigint")
    found = scratch.table(found, "found")

    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select("a", "b"), scratch)
    info = classes.join(links, classes.key == links.a, "left").join(parts, classes.key == parts.node, "left")
    info = info.select("key", "label", "dim", "v", "many", "least_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "key").alias("component"))
    info = scratch.table(info, "components")
    info = scratch.table(with_least(info, scratch, "least_id", "component_id").select("label", "dim", "v", (F.col("n") + F.col("many") - 1).alias("n_links"), "component_id"), "info")
    linked = entries.join(info, ["label", "dim", "v"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
