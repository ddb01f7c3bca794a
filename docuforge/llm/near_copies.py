"""Near copies of at least a given shingle similarity, found by SimHash deletion variants and verified exactly.

The index is that of ``simhash_dedup`` at a wider radius: a similarity of 0.8
moves ten bits of 64 in the median, so 14 are allowed, and a second, independent
fingerprint sorts out chance meetings before any text is compared.  Signature groups
give a spanning forest of the pairs within both radii; inside each tree every such pair
is then verified, block by block, so no group emits or loses pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuforge.llm.common import Scratch, splitmix
from docuforge.llm.components import _flat, _unite, connected_components, with_least
from docuforge.llm.simhash_dedup import _signed, majority, segment_masks, shingle_hashes

#: Members and shingles of a block, about; larger groups are dealt out as pairs of blocks.
BLOCK, BLOCK_SHINGLES = 128, 1 << 20
#: Ids up to which representatives are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000


def _prints(shingle: int, with_set: bool):
    def run(batches):
        for batch in batches:
            first, second, sizes, sets = [], [], [], []
            for x in batch.column(1):
                h = np.unique(shingle_hashes(x.as_py(), shingle))  # without repeats: the similarity is one of sets
                first.append(majority(h))
                second.append(majority(splitmix(h)))
                bag = np.unique((h >> np.uint64(32)).astype(np.uint32))
                sizes.append(len(bag))
                if with_set:
                    sets.append(bag.tobytes())
            columns = [batch.column(0), *(pa.array(np.array(f, np.uint64).view(np.int64)) for f in (first, second))]
            columns.append(pa.array(sets, pa.binary()) if with_set else pa.array(sizes, pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "fp2", "bag" if with_set else "n"])

    return run


def _runs(batches, by: int):
    """The columns of each run of rows with equal values in the first ``by`` columns, of sorted batches."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(by)])
        cut = np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            if (key := tuple(keys[:, lo].tolist())) != now:
                if held:
                    yield pa.Table.from_batches(held).columns
                now, held = key, []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).columns


def _table(a, b):
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _candidates(radius: int, second_radius: int):
    """Per signature group: links that join what pairs within both radii join, one less than its members at most."""

    def forest(fp, fp2, key):
        n = len(key)
        root = np.arange(n)
        for i in range(0, n - 1, 256):  # blocks: bounded memory in a hot group
            for j in range(i, n, 16384):
                x, y = np.nonzero(np.bitwise_count(fp[i : i + 256, None] ^ fp[None, j : j + 16384]) <= radius)
                x, y = x + i, y + j
                near = (x < y) & (np.bitwise_count(fp2[x] ^ fp2[y]) <= second_radius)
                _unite(root, x[near], y[near])
        root = _flat(root)
        child = np.flatnonzero(root != np.arange(n))
        return _table(key[child], key[root[child]])

    def run(batches):
        for _, _, fp, fp2, key in _runs(batches, 2):
            if len(key) > 1:
                yield forest(fp.to_numpy().view(np.uint64), fp2.to_numpy().view(np.uint64), key.to_numpy())

    return run


def _verified(least: float, radius: int, second_radius: int):
    """Per pair of blocks: links that join what pairs within both radii and of enough similarity join."""

    def links(own, fp, fp2, key, bags, across):
        near = (np.bitwise_count(fp[:, None] ^ fp[None]) <= radius) & (np.bitwise_count(fp2[:, None] ^ fp2[None]) <= second_radius)
        if across:  # pairs inside a block are compared where it meets itself
            near &= own[:, None] != own[None]
        size = np.array([len(x) for x in bags])
        near &= np.minimum(size[:, None], size[None]) >= least * np.maximum(size[:, None], size[None])
        label, a, b = np.arange(len(key)), [], []
        for x in range(len(key)):
            others = np.flatnonzero(near[x, :x])
            for y in others[label[others] != label[x]].tolist():
                if label[x] == label[y]:  # joined meanwhile: another link would change nothing
                    continue
                both = len(np.intersect1d(bags[x], bags[y], assume_unique=True))
                if both >= least * (size[x] + size[y] - both):
                    label[label == label[x]] = label[y]
                    a.append(key[x])
                    b.append(key[y])
        return _table(a, b)

    def run(batches):
        for _, i, j, own, fp, fp2, key, bag in _runs(batches, 3):
            if len(key) > 1:
                bags = [np.frombuffer(x, np.uint32) for x in bag.to_pylist()]
                yield links(own.to_numpy(), fp.to_numpy().view(np.uint64), fp2.to_numpy().view(np.uint64), key.to_numpy(), bags, i[0].as_py() != j[0].as_py())

    return run


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 14, second_radius: int = 18) -> DataFrame:
    """(doc_id, component_id) for every row: the smallest id reachable over pairs of similarity ``least`` or more.

    Similarity is the Jaccard similarity of the sets of word shingles (A-Z
    lower-cased; shorter texts are one shingle, texts without words are all alike).  Texts with equal
    fingerprints (of those sets) are one class, so copies never pair up.  The radii bound what is found: at a
    similarity of 0.8 about 95 of 100 pairs, at 0.9 nearly all.  Rows with null ids take the
    component of their text.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = scratch.table(texts.mapInArrow(_prints(shingle, False), f"doc_id {kind}, fp bigint, fp2 bigint, n int"), "prints")
    classes = prints.groupBy("fp", "fp2").agg(F.min("doc_id").alias("least_id"), F.max("n").alias("n"))
    classes = scratch.table(classes.withColumn("key", F.monotonically_increasing_id()), "classes", prints.count())
    n = classes.count()

    masks = F.array(*[F.lit(_signed(m & ~(1 << i))) for i, (_, m) in enumerate(segment_masks(radius))])
    keyed = classes.select("fp", "fp2", "key", F.posexplode(masks).alias("bit", "mask"))
    keyed = keyed.select("bit", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), "fp", "fp2", "key")
    near = keyed.repartition("bit", "rest").sortWithinPartitions("bit", "rest").mapInArrow(_candidates(radius, second_radius), "a bigint, b bigint")
    groups = scratch.table(connected_components(near, scratch).select(F.col("node").alias("key"), F.col("component").alias("group")), "groups", n)
    scratch.release()

    # The shingle sets of one document of each class that is within the radii of another, dealt out as pairs of blocks.
    met = groups.join(classes, "key")
    blocks = met.groupBy("group").agg(F.ceil(F.greatest(F.count("key") / BLOCK, F.sum("n") / BLOCK_SHINGLES, F.lit(1.0))).cast("int").alias("blocks"))
    met = scratch.table(met.join(blocks, "group"), "met", n)
    ids = met.select(F.col("least_id").alias("_id")).distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    bags = texts.join(ids, texts.doc_id == ids["_id"], "left_semi").mapInArrow(_prints(shingle, True), f"doc_id {kind}, fp bigint, fp2 bigint, bag binary")
    bags = bags.join(met, ["fp", "fp2"]).groupBy("group", "blocks", "fp", "fp2", "key").agg(F.first("bag").alias("bag"))
    bags = bags.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = bags.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "fp2", "key", "bag")
    links = dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(_verified(least, radius, second_radius), "a bigint, b bigint")
    labelled = connected_components(links, scratch)
    named = classes.join(labelled, classes.key == labelled.node, "left").select("fp", "fp2", "least_id", F.coalesce("component", "key").alias("component"))
    named = scratch.table(named, "named", n)
    final = with_least(named, scratch, "least_id", "component_id").select("fp", "fp2", "component_id")
    return prints.join(final, ["fp", "fp2"]).select("doc_id", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.  Rows with a null id stay."""
    groups = near_copy_groups(docs, id_col, text_col, **options)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
