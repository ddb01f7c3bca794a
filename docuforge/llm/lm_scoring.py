"""Stupid-backoff language-model scores of a corpus by its own n-gram counts.

N-grams of every order are exploded into fingerprints and dealt by hash to the
buckets of the count tables, packed; each bucket counts its n-grams over all
documents and joins the counts back to the n-grams it was sent; the per-position
scores are summed for each document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuforge.llm import exchange as X
from docuforge.llm.common import Rolling, Scratch, doc_slices, splitmix, text_buffers, word_hashes, words_of

_roll = Rolling(0x9FB21C651E98DF25)
#: Count tables are made in so many rounds, each over its share of the buckets, which bounds the disk in use at once.
ROUNDS = 3
#: Bytes of an n-gram's fingerprint: with fewer, some n-grams of even a small corpus would share a count.
WIDTH = 8


def _ngrams(table: pa.Table, order: int):
    """(word counts of the documents, their offsets, per order the positions and fingerprints of the n-grams that end there)."""
    raw, offsets = text_buffers(table.column("_text"))
    starts, ends, counts = words_of(raw, offsets)
    words, at = word_hashes(raw, starts, ends), doc_slices(counts)
    prefix, grams = _roll.prefix(words), []
    for n in range(1, order + 1):
        room = np.maximum(counts - n + 1, 0)
        first = np.repeat(at[:-1], room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        grams.append((first + n - 1, splitmix(_roll.between(prefix, first, first + n) + np.uint64(n))))
    return counts, at, grams


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, min_count: int = 2, backoff: float = 0.4) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score) of every whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged, and n-grams don't cross documents.
    Counts are over all rows, repeated rows included.  A word scores the share
    of its longest n-gram (up to ``order``) that occurs ``min_count`` times or more
    in its context's count; every order given up multiplies by ``backoff``; single words score
    their share of all words.  Texts without words, nulls included, score 0 and null.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    deal = X.Deal(docs, id_col, text_col, scratch)
    shape = deal.shape(order / 6, least=ROUNDS)

    def explode(table):
        counts, _, grams = _ngrams(table, order)
        f, n = np.unique(np.concatenate([g for _, g in grams]), return_counts=True)
        return f, None, {"n_here": n}, int(counts.sum())

    def count(group, n, seg, along):
        return X.total(group, n, along["n_here"]).astype(np.uint32)

    aux, tables = {"n_here": "u4"}, []
    for r in range(ROUNDS):
        sent = X.send(deal.grouped(), explode, shape, WIDTH, aux, (r, ROUNDS))
        tables.append(scratch.table(X.answer(sent, shape, WIDTH, aux, count), f"counts-{r}"))
        del sent
        scratch.release()
    # Every round passes each segment's number of words on.
    total = tables[0].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def score(table, counted):
        table = X.in_order(table)
        counts, at, grams = _ngrams(table, order)
        f, inverse = np.unique(np.concatenate([g for _, g in grams]), return_inverse=True)
        known = X.codes_of(counted, 0, np.uint32)[inverse].astype(np.float64) if len(f) else np.empty(0)
        n_words = int(counts.sum())
        c, k = np.zeros((order, n_words)), 0
        for n, (ends, g) in enumerate(grams):
            c[n, ends] = known[k : k + len(g)]
            k += len(g)
        value = np.log(c[0] / max(total, 1), where=c[0] > 0, out=np.zeros(n_words))
        for n in range(1, order):
            ends = grams[n][0]
            context = c[n - 1][ends - 1]
            found = c[n][ends] >= min_count
            value[ends] = np.where(found, np.log(np.maximum(c[n][ends], 1)) - np.log(np.maximum(context, 1)), value[ends] + np.log(backoff))
        scores = np.array([value[a:b].sum() for a, b in zip(at[:-1], at[1:])])
        means = pa.array(np.divide(scores, counts, out=np.zeros(len(scores)), where=counts > 0), mask=counts == 0)
        return pa.table({"doc_id": table.column("_id"), "n_tokens": pa.array(counts, pa.int64()), "log_score": pa.array(scores, pa.float64()), "mean_log_score": means})

    return deal.grouped().cogroup(deal.replies(*tables)).applyInArrow(score, "doc_id bigint, n_tokens bigint, log_score double, mean_log_score double")
