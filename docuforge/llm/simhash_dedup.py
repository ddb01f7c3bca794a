"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into fewer segments than twice the radius needs, so that
of two fingerprints within the radius one segment differs by at most one bit.
Every segment is indexed once for each of its bits taken as a wildcard; two
fingerprints meet in an equality join on (wildcard bit, rest of the segment)
and are verified there with the exact Hamming distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuforge.llm.common import Scratch
from docuforge.llm.components import _flat, _unite, connected_components, with_least

BITS = 64
#: Groups up to this size are compared all together, by shifts; larger ones block by block.
SMALL = 8


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, repeats included; of all its words if there are fewer."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(line[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65536):
        part = h[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def _fingerprint(text: str | None, shingle: int) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text as a signed long.

    Lower-cases A-Z, takes words ``[^\\x20\\x09-\\x0D]+`` and word shingles with
    repeats; a text with fewer words than a shingle is one shingle.  Null, empty
    and blank texts have fingerprint zero.
    """

    def run(batches):
        for batch in batches:
            found = np.fromiter((_fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def segment_masks(radius: int) -> list[tuple[int, int]]:
    """For each bit: the mask of its segment.  The fewest segments of which one differs by at most one bit."""
    n = next(m for m in range(1, radius + 2) if radius // m <= 1)
    bounds = [BITS * i // n for i in range(n + 1)]
    return [(s, ((1 << bounds[s + 1]) - (1 << bounds[s])) & ((1 << BITS) - 1)) for s in range(n) for _ in range(bounds[s], bounds[s + 1])]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _forest(radius: int):
    """Per signature group: links that join what is linked inside the group, one less than its members at most."""
    masks = [m for _, m in segment_masks(radius)]

    def table(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def forest(held):
        fps = np.unique(np.concatenate(held)) if held else np.empty(0, np.uint64)
        root = np.arange(len(fps))
        for i in range(0, len(fps) - 1, 256):  # blocks: bounded memory in a hot group
            rows = fps[i : i + 256]
            for j in range(i, len(fps), 16384):
                x, y = np.nonzero(np.bitwise_count(rows[:, None] ^ fps[None, j : j + 16384]) <= radius)
                x, y = x + i, y + j
                _unite(root, x[x < y], y[x < y])
        root = _flat(root)
        child = np.flatnonzero(root != np.arange(len(fps)))
        return table(fps[child], fps[root[child]])

    def run(batches):
        key, held = None, []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            bits, rest = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = batch.column(2).to_numpy().view(np.uint64)
            at = np.flatnonzero(np.concatenate([[True], (np.diff(bits) != 0) | (np.diff(rest) != 0), [True]]))
            first = (bits[0], rest[0])
            if first == key:
                held.append(fps[: at[1]])
                at = at[1:]
            if len(at) > 1:
                yield forest(held)
                last = at[-2]
                key, held = (bits[last], rest[last]), [fps[last:]]
                sizes = np.diff(at[:-1])
                small = np.repeat(sizes <= SMALL, sizes)  # for each row before the last group
                group = np.repeat(np.arange(len(sizes)), sizes)
                body = fps[at[0] : last]
                for d in range(1, SMALL):
                    near = small[d:] & (group[d:] == group[:-d])
                    near[near] = np.bitwise_count(body[d:][near] ^ body[:-d][near]) <= radius
                    if near.any():
                        yield table(body[d:][near], body[:-d][near])
                for k in np.flatnonzero(sizes > SMALL):
                    yield forest([fps[at[k] : at[k + 1]]])
        yield forest(held)

    return masks, run


def linked_fingerprints(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) links among distinct fingerprints whose components are those of all pairs within ``radius``.

    Copies collapse to one fingerprint first.  Inside a signature group the
    pairs within the radius are verified block by block and only a spanning
    forest leaves the group, so no group emits all its pairs.  A group holds
    distinct fingerprints that agree on a whole segment but one bit: 8 bytes each.
    """
    masks, run = _forest(radius)
    bit_mask = F.array(*[F.lit(_signed(m & ~(1 << i))) for i, m in enumerate(masks)])
    variants = fps.select("fp").distinct().select("fp", F.posexplode(bit_mask).alias("bit", "mask"))
    keyed = variants.select(F.col("bit").cast("int"), F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), "fp")
    return keyed.repartition("bit", "rest").sortWithinPartitions("bit", "rest").mapInArrow(run, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest id reachable by links between fingerprints at
    most ``radius`` bits apart.  Repeated rows and equal texts share a
    fingerprint and so a component; rows with null ids take the component of
    their fingerprint (null if it has no other id).  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.table(fingerprints(docs, id_col, text_col, shingle), "fp")
    labelled = connected_components(linked_fingerprints(fps, radius), scratch)
    labelled = scratch.table(labelled, "cc")
    ids = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = ids.join(labelled, ids.fp == labelled.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = scratch.table(ids, "ids")
    named = scratch.table(with_least(ids, scratch, "least", "component_id").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
