"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks, in DataFrame operations only.

Every window of a document that has an item's length and holds one of the
benchmark's shingles gets a SimHash; windows without a shared shingle have similarity zero.
The items' fingerprints are indexed by blocks, with every block value within
the radius' share of a block, so each fingerprint within the radius meets a window in at least one block.
Candidates are verified by the exact similarity of their weighted shingles.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuforge.llm.common import Scratch

BLOCKS, BLOCK_BITS = 8, 8
#: Shingles and documents up to which a side is broadcast (16 bytes a row); larger sides are joined by shuffles.
BROADCAST_ROWS = 1_000_000


def shingles(text: Column, size: int) -> Column:
    """64-bit hashes of the word shingles of a text, in order; words ``[^\\x20\\x09-\\x0D]+`` in lower case, null as empty."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")

    def of(w: Column) -> Column:
        count = F.size(w) - (size - 1)
        hashes = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return F.when(count > 0, hashes).otherwise(F.array().cast("array<bigint>"))

    # Bound as a lambda's variable, the words are made once a row and not once a shingle.
    return F.element_at(F.transform(F.array(words), of), 1)


def _planes(hashes: Column, n: int) -> Column:
    """How often each bit is set among the hashes, as ``n`` bit planes: a counter for 64 bits at once."""

    def add(planes: Column, h: Column) -> Column:
        out, carry = [], h
        for k in range(n):
            p = planes[f"p{k}"]
            out.append(p.bitwiseXOR(carry).alias(f"p{k}"))
            carry = p.bitwiseAND(carry)
        return F.struct(*out)

    return F.aggregate(hashes, F.struct(*[F.lit(0).cast("long").alias(f"p{k}") for k in range(n)]), add)


def with_simhash(df: DataFrame, hashes: str, most: int, name: str) -> DataFrame:
    """``df`` with the 64-bit SimHash of an array of at most ``most`` hashes: a bit is 1 if set in over half of them."""
    n = max(1, most.bit_length())
    df = df.withColumn("_planes", _planes(F.col(hashes), n))
    half = F.floor(F.size(hashes) / 2).cast("int")
    above, equal = F.lit(0).cast("long"), F.lit(-1).cast("long")
    for k in reversed(range(n)):
        p = F.col("_planes")[f"p{k}"]
        bit = -F.shiftright(half, k).bitwiseAND(F.lit(1)).cast("long")  # all ones where half has bit k
        above = above.bitwiseOR(equal.bitwiseAND(p).bitwiseAND(F.bitwise_not(bit)))
        equal = equal.bitwiseAND(F.bitwise_not(p.bitwiseXOR(bit)))
    return df.withColumn(name, above).drop("_planes")


def block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags of shingles: sum of smaller counts by sum of larger ones."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    plain = F.size(F.array_distinct(b)) == F.size(b)  # no repeats: every shared shingle counts once
    both = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(F.array_distinct(b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x))))
    return F.element_at(F.transform(F.array(both), lambda n: n / F.greatest(F.size(a) + F.size(b) - n, F.lit(1))), 1)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 23
) -> DataFrame:
    """(doc_id, item_id, similarity, start): for each document and item that meet, the most similar window.

    A window has as many words as the item, or as the document if that is shorter.
    ``start`` is its first word (from 0), the first one on ties.  Items with
    fewer words than a shingle, nulls included, match nothing; neither do such documents.  Repeated rows count
    once; rows with a null id are left out.  Equal items are all returned.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = benchmark.select(F.col(item_id_col).alias("item_id"), shingles(F.col(item_text_col), shingle).alias("item"))
    items = scratch.table(items.where(F.size("item") > 0).withColumn("m", F.size("item")), "items")
    facts = items.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.max("m"), F.lit(1)), F.count("*")).first()
    n_shingles, most, n_items = (int(x) for x in facts)

    # Where the documents share a shingle with an item, and how long that item is.
    known = items.select(F.explode("item").alias("h"), "m").distinct()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    placed = base.select("doc_id", shingles(F.col("text"), shingle).alias("s")).select("doc_id", F.size("s").alias("n"), F.posexplode("s").alias("pos", "h"))
    hits = placed.join(_sized(known, n_shingles), "h").select("doc_id", "pos", "m").distinct()
    hits = scratch.table(hits, "hits")

    # All windows of those lengths that hold a shared shingle, of the documents that have any.
    ids = hits.select("doc_id").distinct()
    bodies = base.join(_sized(ids, ids.limit(BROADCAST_ROWS + 1).count()), "doc_id", "left_semi")
    bodies = scratch.table(bodies.select("doc_id", shingles(F.col("text"), shingle).alias("s")), "bodies")
    lengths = bodies.select("doc_id", F.size("s").alias("n")).distinct()
    near = hits.join(lengths, "doc_id").where("pos < n").withColumn("w", F.least("m", "n"))
    near = near.withColumn("start", F.explode(F.sequence(F.greatest(F.col("pos") - F.col("w") + 1, F.lit(0)), F.least(F.col("pos"), F.col("n") - F.col("w")))))
    near = near.select("doc_id", "n", "m", "w", "start").distinct()
    bags = near.join(bodies.withColumn("n", F.size("s")), ["doc_id", "n"]).withColumn("bag", F.slice("s", F.col("start") + 1, F.col("w")))
    # Only places and fingerprints are kept; the few windows that meet an item fetch their shingles again.
    windows = scratch.table(with_simhash(bags, "bag", most, "fp").select("doc_id", "n", "m", "w", "start", "fp"), "windows")

    # Multi-index: radius // BLOCKS differing bits at most in some block.
    share = radius // BLOCKS
    masks = [sum(1 << i for i in bits) for k in range(share + 1) for bits in combinations(range(BLOCK_BITS), k)]
    prints = scratch.table(with_simhash(items, "item", most, "item_fp"), "prints")
    blocks = lambda fp: F.explode(F.array(*[F.struct(F.lit(b).alias("b"), block(F.col(fp), b).alias("v")) for b in range(BLOCKS)]))
    index = prints.select("item_id", "m", "item_fp", blocks("item_fp").alias("x"))
    index = index.select("item_id", "m", "item_fp", F.col("x.b").alias("b"), F.explode(F.array(*[F.col("x.v").bitwiseXOR(F.lit(k)) for k in masks])).alias("v"))
    probes = windows.select("*", blocks("fp").alias("x")).select("*", F.col("x.b").alias("b"), F.col("x.v").alias("v")).drop("x")
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*[F.when(F.bit_count(block(apart, b)) <= share, F.lit(b)) for b in range(BLOCKS)])
    met = probes.join(_sized(index, n_items * BLOCKS * len(masks)), ["m", "b", "v"]).where((F.bit_count(apart) <= radius) & (F.col("b") == first))
    met = scratch.table(met.select("doc_id", "n", "w", "item_id", "start"), "met")
    held = met.join(bodies.withColumn("n", F.size("s")), ["doc_id", "n"]).join(_sized(items.select("item_id", "item"), n_shingles), "item_id")
    met = held.select("doc_id", "item_id", "start", weighted_similarity(F.slice("s", F.col("start") + 1, F.col("w")), F.col("item")).alias("similarity"))
    best = met.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("s"))).alias("x"))
    return best.where(F.col("x.similarity") >= least).select("doc_id", "item_id", F.col("x.similarity").alias("similarity"), (-F.col("x.s")).alias("start"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold an item of the benchmark; rows with a null id stay."""
    scratch = Scratch(docs.sparkSession, "clean")
    found = scratch.table(contaminated(docs, benchmark, id_col, **options).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(_sized(found, found.limit(BROADCAST_ROWS + 1).count()), docs[id_col] == found["_leak"], "left_anti")
