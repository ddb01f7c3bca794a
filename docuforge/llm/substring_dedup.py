"""Substring dedup by fixed-block anchors.

Every document's non-overlapping blocks of half a window are the reference
index; every rolling window of a block's length probes it.  A window as long
as two blocks always holds a whole block of the document it repeats, so only
windows around a hit can be repeats.  Hits are extended to maximal exact
repeats by comparing whole windows around them; their union is removed.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docuforge.llm import exchange as X
from docuforge.llm.common import Rolling, Scratch, doc_slices, text_buffers, word_hashes, words_of

_roll, _roll_more = Rolling(0xD1342543DE82EF95), Rolling(0xAF251AF3B0F025B5)
_NO_ID = np.iinfo(np.int64).max


class _Segment:
    """Word hashes of a segment's documents, concatenated, and the start positions of their windows."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.block = window, max(1, window // 2)
        raw, offsets = text_buffers(table.column("_text"))
        starts, ends, self.counts = words_of(raw, offsets)
        self.words, self.at = word_hashes(raw, starts, ends), doc_slices(self.counts)
        self.ids = table.column("_id").fill_null(_NO_ID).to_numpy()
        self.prefix = _roll.prefix(self.words)

    def starts(self, length: int) -> np.ndarray:
        """Starts of runs of ``length`` words inside one document, of documents that have a whole window."""
        room = np.where(self.counts >= self.window, self.counts - length + 1, 0)
        within = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        return np.repeat(self.at[:-1], room) + within

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, position, "right") - 1

    def probes(self):
        """Positions of the rolling blocks, whether each is a reference block, and their fingerprints."""
        p = self.starts(self.block)
        offset = p - self.at[self.doc_of(p)] if len(p) else p
        return p, offset % self.block == 0, _roll.between(self.prefix, p, p + self.block)

    def candidates(self, hit: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Starts of windows that hold a hit."""
        marks = np.zeros(len(self.words) + 1, np.int64)
        marks[p[hit] + 1] = 1
        seen = np.cumsum(marks)
        s = self.starts(self.window)
        return s[seen[np.minimum(s + self.window - self.block + 1, len(self.words))] > seen[s]]

    def windows(self, s: np.ndarray):
        """Distinct whole windows at the starts ``s``: 96-bit fingerprints, the smallest id of each, and where each start belongs."""
        f = _roll.between(self.prefix, s, s + self.window)
        prefix = _roll_more.prefix(self.words)
        g = (_roll_more.between(prefix, s, s + self.window) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((g, f))
        fresh = np.concatenate([np.ones(min(1, len(f)), bool), (f[order][1:] != f[order][:-1]) | (g[order][1:] != g[order][:-1])])
        inverse = np.empty(len(f), np.int64)
        inverse[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        least = np.full(len(first), _NO_ID)
        np.minimum.at(least, inverse, self.ids[self.doc_of(s)])
        return f[first], g[first], least, inverse


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with every field nullable, as a schema string means it."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, _nullable(kind.value_type)))
    if pa.types.is_map(kind):
        return pa.map_(kind.key_type, pa.field("value", _nullable(kind.item_type)))
    return kind


def _hits(segment: _Segment, replies: pa.Table):
    p, _, f = segment.probes()
    _, inverse = np.unique(f, return_inverse=True)
    return p, X.codes_of(replies, 0, np.uint8)[inverse].astype(bool) if len(f) else np.zeros(0, bool)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, carry: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row, and all columns of ``docs`` as struct ``_row`` with ``carry``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A word goes if a window of ``window``
    words over it also starts in a document with a smaller id; windows are
    judged on the input.  Kept words are joined by one space.  Null texts have
    no words; texts shorter than a window stay.  Rows with equal ids never remove each
    other's words, so repeated rows stay alike; rows without an id count as the
    largest.  Ids must be integers.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    deal = X.Deal(docs, id_col, text_col, scratch, carry)
    shape = deal.shape(1 / 6)

    def probe(table):
        _, anchor, f = _Segment(X.in_order(table), window).probes()
        f, inverse, counts = np.unique(f, return_inverse=True, return_counts=True)
        flags = np.minimum(counts, 2).astype(np.uint8)
        flags[inverse[anchor]] |= 4
        return f, None, {"flags": flags}, 0

    def shared(group, n, seg, along):
        known = X.total(group, n, (along["flags"] & 4) > 0) > 0
        return (known & (X.total(group, n, along["flags"] & 3) > 1)).astype(np.uint8)

    aux = {"flags": "u1"}
    hits = scratch.table(X.answer(X.send(deal.grouped(), probe, shape, 5, aux), shape, 5, aux, shared), "hits")
    scratch.release()

    def extend(docs_table, replies):
        if not docs_table.num_rows:
            return np.empty(0, np.uint64), np.empty(0, np.uint32), {"least": np.empty(0, np.int64)}, 0
        segment = _Segment(X.in_order(docs_table), window)
        p, hit = _hits(segment, replies)
        f, g, least, _ = segment.windows(segment.candidates(hit, p))
        return f, g, {"least": least}, 0

    def smaller(group, n, seg, along):
        least = np.full(n, _NO_ID)
        np.minimum.at(least, group, along["least"])
        return (least[group] < along["least"]).astype(np.uint8)

    aux = {"least": "i8"}
    sent = X.send(deal.grouped().cogroup(deal.replies(hits)), extend, shape, 8, aux)
    firsts = scratch.table(X.answer(sent, shape, 8, aux, smaller, kind=1), "firsts")
    scratch.release()

    def cut(docs_table, replies_table):
        table = X.in_order(docs_table)
        segment = _Segment(table, window)
        n = len(segment.counts)
        p, hit = _hits(segment, replies_table)
        s = segment.candidates(hit, p)
        _, _, least, inverse = segment.windows(s)
        earlier = X.codes_of(replies_table, 1, np.uint8).astype(bool)
        gone = s[earlier[inverse] | (segment.ids[segment.doc_of(s)] > least[inverse])] if len(s) else s
        cover = np.zeros(len(segment.words) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + window, -1)
        kept = np.cumsum(cover[:-1]) == 0
        texts, removed = [], np.zeros(n, np.int64)
        for i, x in enumerate(table.column("_text").to_pylist()):
            mine = kept[segment.at[i] : segment.at[i + 1]]
            words = (x or "").encode().split()
            removed[i] = len(mine) - mine.sum()
            texts.append(b" ".join(compress(words, mine.tolist()) if removed[i] else words).decode())
        out = {"doc_id": table.column("_id"), "n_words": pa.array(segment.counts, pa.int64()), "n_removed": pa.array(removed), "kept_text": pa.array(texts, pa.string())}
        return pa.table(out | ({"_row": table.column("_row").cast(_nullable(table.schema.field("_row").type))} if carry else {}))

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"
    if carry:
        schema += f", _row {docs.schema.simpleString()}"
    return deal.grouped(carry).cogroup(deal.replies(hits, firsts)).applyInArrow(cut, schema)
