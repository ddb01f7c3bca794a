"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Texts become term counts (hashed byte bigrams, hashed words, and words that repeat one of the
last three; square root, inverse document frequency), projected on the leading latent directions of a labelled sample.
The labelled vectors are broadcast, which their documented bound allows.  Every
document is compared with all of them, block by block, by exact cosine
products; its nearest neighbours vote, each with its cosine as weight (0 if negative).
Of labelled vectors equally near, the ones with smaller ids are the neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuforge.llm.common import batches_of, splitmix, text_buffers, word_hashes, words_of

BIGRAMS, LAGS, WORDS = 1024, (1, 2, 3), 512
FEATURES = BIGRAMS + len(LAGS) + WORDS
#: How much the shares of repeated words, and of words, weigh against the shares of bigrams.
REPEAT_WEIGHT, WORD_WEIGHT = 2.0, 0.5
#: Hash bucket of each byte bigram.
_BUCKET = (splitmix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BIGRAMS)).astype(np.int32)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of bigrams, repeated words and words of each document, one row each."""
    n = len(offsets) - 1
    out = np.zeros((n, BIGRAMS), np.float32)
    for i in range(n):
        for lo in range(int(offsets[i]), int(offsets[i + 1]) - 1, 1 << 20):  # blocks overlap by one byte
            x = raw[lo : min(lo + (1 << 20) + 1, int(offsets[i + 1]))].astype(np.int32)
            out[i] += np.bincount(_BUCKET[(x[:-1] << 8) | x[1:]], minlength=BIGRAMS)
    total = out.sum(1, keepdims=True)
    starts, ends, counts = words_of(raw[offsets[0] : offsets[-1]], offsets - offsets[0])
    words, doc = word_hashes(raw[offsets[0] : offsets[-1]], starts, ends), np.repeat(np.arange(n), counts)
    again = np.stack([np.bincount(doc[k:], (words[k:] == words[:-k]) & (doc[k:] == doc[:-k]), n) for k in LAGS], 1).astype(np.float32)
    again *= REPEAT_WEIGHT**2 / np.maximum(counts, 1)[:, None].astype(np.float32)
    n_words = np.maximum(counts, 1)[:, None].astype(np.float32)
    bag = np.bincount(doc * WORDS + (words % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS).astype(np.float32)
    return np.sqrt(np.concatenate([out / np.maximum(total, 1), again, bag * (WORD_WEIGHT**2 / n_words)], 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int, id_col: str, text_col: str, label_col: str, train) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of at most ``max_labelled`` labelled training rows, chosen by a hash of the id."""
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
    ids = ids.where(train(F.col("_id"))).groupBy("_id").agg(F.min("_y").alias("_y"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            rows = [r for i, j in batches_of(offsets) for r in features(raw, offsets[i : j + 1]).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], names=["_id", "_y", "_f"])

    kind = docs.schema[id_col].dataType.simpleString()
    # The sample has at most max_labelled ids of 12 bytes: small enough to broadcast by its own bound.
    found = texts.join(F.broadcast(ids), "_id").select("_id", "_text", "_y").mapInArrow(run, f"_id {kind}, _y int, _f binary")
    rows = found.toArrow()
    if rows.num_rows == 0:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0)
    x = np.frombuffer(b"".join(rows.column("_f").to_pylist()), np.float16).reshape(-1, FEATURES).astype(np.float32)
    y = np.asarray(rows.column("_y").to_pylist(), np.float64)
    order = np.lexsort((y, rows.column("_id").to_numpy()))
    return x[order], y[order]


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of the ``k`` largest values; of equal values the first columns."""
    last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    chosen, tied = cosine > last, cosine == last
    room = k - chosen.sum(1, keepdims=True)
    chosen |= tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= room)
    return np.nonzero(chosen)[1].reshape(len(cosine), k)


class Neighbours:
    """A fitted model: the projection, the labelled vectors and the share of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, dims: int = 48, k: int = 25):
        self.k, self.y = min(k, len(y)), y
        self.prior = float(y.mean()) if len(y) else 0.5
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        weighted = x * self.idf
        _, axes = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
        self.axes = np.ascontiguousarray(axes[:, ::-1][:, :dims]).astype(np.float32)
        self.vectors = self._unit(weighted @ self.axes)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.k:
            return np.full(len(x), self.prior)
        v, out = self._unit((x * self.idf) @ self.axes), np.empty(len(x))
        for i in range(0, len(v), 256):
            cosine = v[i : i + 256] @ self.vectors.T
            near = nearest(cosine, self.k)
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64)
            # A small vote for the prior keeps texts without any neighbour, such as empty ones, defined.
            out[i : i + 256] = ((weight * self.y[near]).sum(1) + 1e-3 * self.prior) / (weight.sum(1) + 1e-3)
        return np.clip(out, 0, 1)


def held_out(column):
    """Whether crc32 of the id as text leaves remainder 0 by 5."""
    return F.crc32(column.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 6000, dims: int = 48, k: int = 25) -> Neighbours:
    """Fit on labelled rows that aren't held out; ``max_labelled`` bounds the sample, and so the broadcast (48 floats a row).

    Labels with a null id or value are dropped; an id labelled twice counts as
    its lower label.  Without labels every score is 0.5.
    """
    x, y = labelled_sample(docs, labels, max_labelled, id_col, text_col, label_col, lambda c: ~held_out(c))
    return Neighbours(x, y, dims, k)


def with_score(docs: DataFrame, model: Neighbours, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None, at_least: float | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and the score of each whole text; null texts score as empty ones.

    With ``at_least``, only rows that score so much come out.  A column already named
    like ``score_col`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (keep or docs.columns) if c != score_col]

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            scores = np.empty(batch.num_rows)
            for i, j in batches_of(offsets):
                for a in range(i, j, 2048):
                    b = min(a + 2048, j)
                    scores[a:b] = shared.value.score(features(raw, offsets[a : b + 1]))
            out = pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], names=[*keep, score_col])
            yield out if at_least is None else out.filter(pa.compute.greater_equal(out.column(len(keep)), at_least))

    schema = docs.select(keep).schema.add(score_col, "double")
    return docs.select(F.col(text_col).alias("_scored_text"), *keep).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, **fitting) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = fit(docs, labels, id_col, text_col, label_col, **fitting)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_score(rows, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
