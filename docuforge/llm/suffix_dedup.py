"""Suffix-array dedup of byte strings by prefix-free parsing.

A rolling-hash trigger starts a phrase wherever the next bytes hash to a given
residue, so equal strings are cut alike; a phrase reaches over the next trigger,
so no phrase is a prefix of another.  The corpus becomes a dictionary of phrases and a parse.
Suffixes are put in order in two steps, as their arrays combine: parse
suffixes first, as the phrase with the text that follows it; then, only for
one occurrence of each such context, the suffixes inside the phrase.  Equal prefixes
stand side by side in that order, and a suffix whose prefix of the wanted length has an
equal neighbour is a repeat.  In a repetitive corpus the second step handles each
distinct context once, however often it occurs.

Prefixes are ordered by 96-bit fingerprints, bucket by bucket, and not by their bytes:
neighbours are equal exactly as in byte order, and no prefix has to be moved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docuforge.llm import exchange as X
from docuforge.llm.common import BYTE_VALUES, Rolling, Scratch, text_buffers

TRIGGER, DENSITY = 8, 32
_roll, _more = Rolling(0xC6A4A7935BD1E995), Rolling(0xE7037ED1A0B428DB)
#: Keeps phrases and contexts of the same bytes apart.
_PHRASE, _CONTEXT = np.uint64(0x632BE59BD9B4E019), np.uint64(0x8CB92BA72F3D8DD7)


class _Segment:
    """Byte hashes of a segment's documents, concatenated, and their phrases."""

    def __init__(self, table: pa.Table, length: int):
        self.length = length
        self.raw, self.at = text_buffers(table.column("_text"))
        values = BYTE_VALUES[self.raw]
        self.prefix, self.prefix_more = _roll.prefix(values), _more.prefix(values)
        n = len(self.raw)
        #: End of the document of each byte.
        self.end = np.repeat(self.at[1:], np.diff(self.at))
        i = np.arange(max(0, n - TRIGGER + 1))
        h = _roll.between(self.prefix, i, i + TRIGGER)
        self.x = i[(h % np.uint64(DENSITY) == 0) & (i + TRIGGER <= self.end[: len(i)])]
        # Phrases end with the trigger of the next one; the last of a document has no end and is left out.
        start, after = self.x[:-1], self.x[1:]
        whole = after < self.end[start] if len(start) else np.zeros(0, bool)
        self.start, self.next = start[whole], after[whole]

    def prints(self, a: np.ndarray, b: np.ndarray, salt: np.uint64 = np.uint64(0)):
        f = _roll.between(self.prefix, a, b) ^ salt
        return f, (_more.between(self.prefix_more, a, b) >> np.uint64(32)).astype(np.uint32)

    def keys(self):
        """Fingerprints of all phrases, then of all contexts; and which phrases have a whole context."""
        until = self.next - 1 + self.length
        whole = until <= self.end[self.start] if len(self.start) else np.zeros(0, bool)
        pf, pg = self.prints(self.start, self.next + TRIGGER, _PHRASE)
        cf, cg = self.prints(self.start[whole], until[whole], _CONTEXT)
        return np.concatenate([pf, cf]), np.concatenate([pg, cg]), whole

    def windows(self, codes: np.ndarray, inverse: np.ndarray, whole: np.ndarray, first: np.ndarray):
        """(known repeats, windows to compare, which of these stand for more than one).

        ``codes``: of the distinct keys, bit 0 if it repeats, bit 1 if this
        segment has its first occurrence.  ``first``: whether each key is the segment's first of its kind.
        """
        n, k = len(self.raw), len(self.start)
        mine = codes[inverse]
        repeated = (mine & 1) > 0
        valid = np.arange(n) + self.length <= self.end
        # The next phrase at or after each position that occurs nowhere else: a window that holds it is no repeat.
        nearest = np.full(n + 1, np.iinfo(np.int64).max)
        alone = ~repeated[:k]
        nearest[self.start[alone]] = (self.next + TRIGGER)[alone]
        nearest = np.minimum.accumulate(nearest[::-1])[::-1][:n]
        open_ = valid & (nearest > np.arange(n) + self.length)
        # Positions inside phrases whose context repeats: all repeats; one occurrence speaks for them.
        context = np.flatnonzero(whole)
        many = repeated[k:]
        speaks = many & ((mine[k:] & 2) > 0) & first[k:]
        known, quiet = self._mark(context[many]), self._mark(context[many & ~speaks])
        sent = open_ & ~quiet
        return known & valid, np.flatnonzero(sent), known[sent]

    def _mark(self, phrases: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(self.raw) + 1, np.int64)
        np.add.at(edge, self.start[phrases], 1)
        np.add.at(edge, self.next[phrases], -1)
        return np.cumsum(edge[:-1]) > 0


def _distinct(f: np.ndarray, g: np.ndarray):
    """(first index of each distinct pair in order, the pair of each entry, whether each entry is the first of its pair)."""
    order = np.lexsort((g, f))
    fresh = np.concatenate([np.ones(min(1, len(f)), bool), (f[order][1:] != f[order][:-1]) | (g[order][1:] != g[order][:-1])])
    inverse = np.empty(len(f), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    first = np.zeros(len(f), bool)
    first[order[fresh]] = True
    return order[fresh], inverse, first


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row; ``kept`` is binary, as cuts may split characters.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else,
    in the same document too; strings don't cross documents, overlap freely and are judged on the
    input.  Null and empty texts have 0 bytes; shorter texts stay.
    Repeated rows are repeats of each other.  Ids must be integers; null ids pass through.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    deal = X.Deal(docs, id_col, text_col, scratch, shrink=2)  # some 100 bytes of arrays stand for each byte of text
    by_key, by_window = deal.shape(2 / DENSITY), deal.shape(1 / 4)

    def keys(table):
        f, g, _ = _Segment(X.in_order(table), length).keys()
        at, inverse, _ = _distinct(f, g)
        return f[at], g[at], {"n_here": np.minimum(np.bincount(inverse, minlength=len(at)), 2)}, 0

    def rank(group, n, seg, along):
        """Bit 0: the key has a neighbour of its own; bit 1: the segment is the first that holds it."""
        first = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(first, group, seg.astype(np.int64))
        return ((X.total(group, n, along["n_here"]) > 1) | ((first[group] == seg) * 2)).astype(np.uint8)

    aux = {"n_here": "u1"}
    known = scratch.table(X.answer(X.send(deal.grouped(), keys, by_key, 8, aux), by_key, 8, aux, rank), "keys")
    scratch.release()

    def opened(docs_table, replies):
        segment = _Segment(docs_table, length)
        f, g, whole = segment.keys()
        _, inverse, first = _distinct(f, g)
        repeats, at, stands = segment.windows(X.codes_of(replies, 0, np.uint8), inverse, whole, first)
        wf, wg = segment.prints(at, at + length)
        return segment, repeats, at, stands, wf, wg

    def inner(docs_table, replies):
        if not docs_table.num_rows:
            return np.empty(0, np.uint64), np.empty(0, np.uint32), {"n_here": np.empty(0)}, 0
        _, _, _, stands, f, g = opened(X.in_order(docs_table), replies)
        at, inverse, _ = _distinct(f, g)
        n = np.bincount(inverse, weights=1 + stands, minlength=len(at))
        return f[at], g[at], {"n_here": np.minimum(n, 2)}, 0

    def repeated(group, n, seg, along):
        return (X.total(group, n, along["n_here"]) > 1).astype(np.uint8)

    sent = X.send(deal.grouped().cogroup(deal.replies(known)), inner, by_window, 8, aux)
    windows = scratch.table(X.answer(sent, by_window, 8, aux, repeated, kind=1), "windows")
    scratch.release()

    def cut(docs_table, replies_table):
        table = X.in_order(docs_table)
        segment, repeats, at, _, f, g = opened(table, replies_table)
        _, inverse, _ = _distinct(f, g)
        codes = X.codes_of(replies_table, 1, np.uint8)
        repeats[at[codes[inverse] > 0] if len(at) else at] = True
        edge = np.zeros(len(segment.raw) + 1, np.int64)
        starts = np.flatnonzero(repeats)
        edge[starts] += 1
        edge[starts + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        removed, spans, kept = [], [], []
        for a, b in zip(segment.at[:-1], segment.at[1:]):
            mine = gone[a:b]
            removed.append(int(mine.sum()))
            spans.append(int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()))
            kept.append(segment.raw[a:b][~mine].tobytes() if removed[-1] else segment.raw[a:b].tobytes())
        return pa.table(
            {"doc_id": table.column("_id"), "n_bytes": pa.array(np.diff(segment.at)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())}
        )

    return deal.grouped().cogroup(deal.replies(known, windows)).applyInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
