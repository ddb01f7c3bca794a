"""Counting and looking up fingerprints of a whole corpus by packed exchange.

Documents are dealt to *segments* by a hash of id and text; rows that repeat
beyond a segment's volume are dealt at random, once, and kept as a table.  A segment sends
its distinct fingerprints, sorted, as one packed row for each *bucket* of the
fingerprint space; a bucket sees every segment's fingerprints and answers each
segment with one code for each of them; the answers meet the segment's
documents again in a co-grouped pass.  A hot fingerprint costs one entry a
segment, whatever its frequency, so no key gathers rows; segments and buckets
hold a fixed volume, so their number, not their size, grows with the corpus.

Segments times buckets grows with the square of the corpus.  Where that would leave
fewer than ``MIN_ENTRIES`` fingerprints in a packed row, rows travel in two
steps: from a segment to a range of ``fan`` buckets, where those of ``fan`` segments are
merged and dealt on to the buckets; answers take the same way back.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from docuforge.llm.common import Scratch, partitions_for

#: Text bytes of a segment, what a row weighs beside its text, and fingerprints of a bucket.
SEGMENT_BYTES, ROW_BYTES, BUCKET_ITEMS = 2 << 20, 64, 2 << 20
#: Fingerprints in a packed row, on average, below which rows travel in two steps.
MIN_ENTRIES = 64

Sent = tuple[np.ndarray, np.ndarray | None, dict[str, np.ndarray], int]


class Shape(NamedTuple):
    """How many segments send to how many buckets.

    ``fan``: buckets of a range, and segments merged for it; 1 where rows go to the buckets directly.
    """

    segments: int
    buckets: int
    fan: int


class Deal:
    """Documents dealt to segments, alike in every pass over them.

    A segment is a hash of id and text, so equal rows share one.  Equal rows that
    outweigh a segment together are dealt to all segments at random and written down.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, carry: bool = False, shrink: int = 1):
        """Segments hold ``1 / shrink`` of the usual volume; ``carry``: all columns of ``docs`` go along as a struct ``_row``."""
        key, size = F.xxhash64(docs[id_col], docs[text_col]), F.coalesce(F.octet_length(docs[text_col]), F.lit(0))
        most = max(1, SEGMENT_BYTES // shrink)
        groups = docs.groupBy(key.alias("_key")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.sum(size + ROW_BYTES).alias("load"))
        self.n_bytes, load, heaviest = groups.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("bytes"), F.sum("load"), F.max(F.when(F.col("n") > 1, F.col("load"))))]).first()
        self.segments = max(1, -(-load // most))
        self.parts = partitions_for(docs.sparkSession, self.segments)
        own = [F.struct(*[docs[c] for c in docs.columns]).alias("_row")] if carry else []
        rows = docs.select(key.alias("_key"), docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"), *own)
        seg = F.pmod("_key", F.lit(self.segments)).cast("int").alias("_seg")
        columns = [c for c in rows.columns if c != "_key"]
        if heaviest > most and self.segments > 1:
            heavy = scratch.table(groups.filter((F.col("n") > 1) & (F.col("load") > most)).select("_key"), "heavy")
            spread = F.floor(F.rand(1) * self.segments).cast("int").alias("_seg")
            hot = scratch.table(rows.join(heavy, "_key", "left_semi").select(spread, *columns), "repeated")
            self.rows = rows.join(heavy, "_key", "left_anti").select(seg, *columns).union(hot)
        else:
            self.rows = rows.select(seg, *columns)

    def grouped(self, carry: bool = False):
        """Groups of (_seg, _id, _text) and, with ``carry``, ``_row``."""
        found = self.rows if carry else self.rows.select("_seg", "_id", "_text")
        return found.repartition(self.parts, "_seg").groupBy("_seg")

    def replies(self, *tables: DataFrame):
        """Groups of the answers to each segment."""
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out.select("_seg", "kind", "bucket", "codes").repartition(self.parts, "_seg").groupBy("_seg")

    def shape(self, items_per_byte: float, least: int = 1) -> Shape:
        buckets = max(least, int(self.n_bytes * items_per_byte / BUCKET_ITEMS) + 1)
        return Shape(self.segments, buckets, 1 if self.segments * MIN_ENTRIES <= BUCKET_ITEMS else math.isqrt(buckets - 1) + 1)


def in_order(table: pa.Table) -> pa.Table:
    """A segment's rows in an order that every pass agrees on, up to equal rows."""
    return table.sort_by([("_id", "ascending"), ("_text", "ascending")])


def buckets_of(f: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of each fingerprint; it grows with the fingerprint."""
    return ((f >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


def pack(f: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each fingerprint, one row each."""
    return f.view(np.uint8).reshape(-1, 8)[:, :width]


def unpack(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view(np.uint64).ravel()


def send(grouped, compute: Callable[..., Sent], shape: Shape, width: int, aux: dict[str, str], rounds: tuple[int, int] = (0, 1)) -> DataFrame:
    """Rows (seg, bucket, fps, more, n, aux...) of what ``compute`` makes of each segment; the bucket is a range's number where there are ranges.

    ``compute`` returns sorted distinct fingerprints, optionally 32 more bits of
    each, arrays alongside (``aux``: name to dtype) and a count to pass on.
    ``rounds`` = (r, of): only buckets (or ranges) whose number is r modulo ``of``.
    """
    n_out, width = -(-shape.buckets // shape.fan), width if shape.fan == 1 else 8

    def run_all(*groups: pa.Table) -> pa.Table:
        f, more, along, n = compute(*groups)
        r, of = rounds
        at = np.searchsorted(buckets_of(f, shape.buckets), np.arange(n_out + 1, dtype=np.uint64) * np.uint64(shape.fan))
        full = [b for b in range(r, n_out, of) if at[b] < at[b + 1]] or [r] * bool(n)
        cut = lambda x: [x[at[b] : at[b + 1]].tobytes() for b in full]
        seg = next((g.column("_seg")[0].as_py() for g in groups if g.num_rows), 0)
        return pa.table(
            {
                "seg": pa.array([seg] * len(full), pa.int32()),
                "bucket": pa.array(full, pa.int32()),
                "fps": pa.array(cut(np.ascontiguousarray(pack(f, width))), pa.binary()),
                "more": pa.array(cut(more) if more is not None else [None] * len(full), pa.binary()),
                "n": pa.array([n] + [0] * (len(full) - 1) if full else [], pa.int64()),
                **{k: pa.array(cut(along[k].astype(t)), pa.binary()) for k, t in aux.items()},
            }
        )

    def one(docs: pa.Table) -> pa.Table:
        return run_all(docs)

    def two(docs: pa.Table, replies: pa.Table) -> pa.Table:
        return run_all(docs, replies)

    schema = "seg int, bucket int, " + _sent_schema(aux)
    return grouped.applyInArrow(two if isinstance(grouped, PandasCogroupedOps) else one, schema)


def _sent_schema(aux) -> str:
    return "fps binary, more binary, n bigint" + "".join(f", {k} binary" for k in aux)


def _blob(table: pa.Table, column: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype)


def _merged(sent: DataFrame, shape: Shape, aux: dict[str, str]) -> DataFrame:
    """Rows (crowd, bucket, segs, lens, fps, ...): of ``fan`` segments, a crowd, what they sent to one bucket, one segment after the other."""

    def run(table: pa.Table) -> pa.Table:
        sizes = np.array([len(x) // 8 for x in table.column("fps").to_pylist()], np.int64)
        f = unpack(b"".join(table.column("fps").to_pylist()), 8)
        seg = np.repeat(table.column("seg").to_numpy(), sizes)
        bucket = buckets_of(f, shape.buckets).astype(np.int64)
        order = np.lexsort((seg, bucket))  # stable: a segment's fingerprints stay in order
        f, seg, bucket = f[order], seg[order], bucket[order]
        full, at = np.unique(bucket, return_index=True)
        total_n = sum(table.column("n").to_pylist())
        if not len(full) and total_n:
            full, at = np.array([table.column("bucket")[0].as_py() * shape.fan]), np.zeros(1, np.int64)
        at = np.append(at, len(f))
        runs = [np.unique(seg[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:])]
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
        has_more = table.column("more").null_count == 0
        return pa.table(
            {
                "crowd": pa.array([table.column("crowd")[0].as_py()] * len(full), pa.int32()),
                "bucket": pa.array(full, pa.int32()),
                "segs": pa.array([s.astype(np.int32).tobytes() for s, _ in runs], pa.binary()),
                "lens": pa.array([n.astype(np.int32).tobytes() for _, n in runs], pa.binary()),
                "fps": cut(f),
                "more": cut(_blob(table, "more", np.uint32)[order]) if has_more else pa.nulls(len(full), pa.binary()),
                "n": pa.array([total_n] + [0] * (len(full) - 1) if len(full) else [], pa.int64()),
                **{k: cut(_blob(table, k, t)[order]) for k, t in aux.items()},
            }
        )

    crowds = sent.withColumn("crowd", F.floor(F.col("seg") / shape.fan).cast("int"))
    parts = partitions_for(sent.sparkSession, -(-shape.segments // shape.fan) * -(-shape.buckets // shape.fan))
    return crowds.repartition(parts, "crowd", "bucket").groupBy("crowd", "bucket").applyInArrow(run, "crowd int, bucket int, segs binary, lens binary, " + _sent_schema(aux))


def _split(answers: DataFrame, shape: Shape) -> DataFrame:
    """The answers to crowds as answers to their segments, one a range of buckets."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        seg = np.repeat(_blob(table, "segs", np.int32), _blob(table, "lens", np.int32))
        order, codes = np.argsort(seg, kind="stable"), _blob(table, "codes", np.uint8)
        codes = codes.reshape(len(seg), -1)[order] if len(seg) else codes
        segs, at = np.unique(seg[order], return_index=True)
        total_n = sum(table.column("n").to_pylist())
        if not len(segs) and total_n:
            segs, at = np.array([table.column("crowd")[0].as_py() * shape.fan]), np.zeros(1, np.int64)
        at = np.append(at, len(seg))
        return pa.table(
            {
                "_seg": pa.array(segs, pa.int32()),
                "kind": pa.array([table.column("kind")[0].as_py()] * len(segs), pa.int32()),
                "bucket": pa.array([table.column("bucket")[0].as_py() // shape.fan] * len(segs), pa.int32()),
                "codes": pa.array([codes[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                "n": pa.array([total_n] + [0] * (len(segs) - 1) if len(segs) else [], pa.int64()),
            }
        )

    span = F.floor(F.col("bucket") / shape.fan).cast("int")
    parts = partitions_for(answers.sparkSession, -(-shape.segments // shape.fan) * -(-shape.buckets // shape.fan))
    return answers.withColumn("span", span).repartition(parts, "crowd", "span").groupBy("crowd", "span").applyInArrow(run, "_seg int, kind int, bucket int, codes binary, n bigint")


def answer(sent: DataFrame, shape: Shape, width: int, aux: dict[str, str], decide: Callable[..., np.ndarray], kind: int = 0) -> DataFrame:
    """Rows (_seg, kind, bucket, codes, n): one code for each fingerprint that a segment sent to the bucket.

    ``decide(group, n_groups, seg, aux)`` gets for every entry the number of its
    fingerprint in the bucket and what came with it, and returns the entries' codes.
    """
    crowded = shape.fan > 1
    width = 8 if crowded else width

    def run(table: pa.Table) -> pa.Table:
        fps = unpack(b"".join(table.column("fps").to_pylist()), width)
        sizes = np.array([len(x) // width for x in table.column("fps").to_pylist()], np.int64)
        seg = np.repeat(_blob(table, "segs", np.int32), _blob(table, "lens", np.int32)) if crowded else np.repeat(table.column("seg").to_numpy(), sizes)
        along = {k: _blob(table, k, t) for k, t in aux.items()}
        if table.column("more").null_count == 0:
            more = _blob(table, "more", np.uint32)
            order = np.lexsort((more, fps))
            fresh = np.concatenate([np.ones(min(1, len(fps)), bool), (fps[order][1:] != fps[order][:-1]) | (more[order][1:] != more[order][:-1])])
        else:
            order = np.argsort(fps)
            fresh = np.concatenate([np.ones(min(1, len(fps)), bool), fps[order][1:] != fps[order][:-1]])
        group = np.empty(len(fps), np.int64)
        group[order] = np.cumsum(fresh) - 1
        codes = decide(group, int(fresh.sum()), seg, along)
        ends = np.cumsum(sizes)
        to = {k: table.column(k) for k in ("crowd", "segs", "lens")} if crowded else {"_seg": table.column("seg")}
        return pa.table(
            {
                **to,
                "kind": pa.array([kind] * table.num_rows, pa.int32()),
                "bucket": table.column("bucket"),
                "codes": pa.array([codes[b - s : b].tobytes() for s, b in zip(sizes, ends)], pa.binary()),
                "n": table.column("n"),
            }
        )

    dealt = (_merged(sent, shape, aux) if crowded else sent).repartition(partitions_for(sent.sparkSession, shape.buckets), "bucket")
    to = "crowd int, segs binary, lens binary" if crowded else "_seg int"
    found = dealt.groupBy("bucket").applyInArrow(run, f"{to}, kind int, bucket int, codes binary, n bigint")
    return _split(found, shape) if crowded else found


def codes_of(replies: pa.Table, kind: int, dtype) -> np.ndarray:
    """A segment's codes in the order of its sorted distinct fingerprints."""
    mine = replies.filter(pa.compute.equal(replies.column("kind"), kind)).sort_by("bucket")
    return np.frombuffer(b"".join(mine.column("codes").to_pylist()), dtype)


def total(group: np.ndarray, n_groups: int, amounts: np.ndarray) -> np.ndarray:
    """Per entry: the sum over its fingerprint's entries."""
    return np.bincount(group, weights=amounts, minlength=n_groups)[group]
