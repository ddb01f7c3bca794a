"""Substring dedup, LM scoring and suffix dedup against brute force."""

import hashlib
import math
import random
from collections import Counter

import pytest

from docuforge.llm.lm_scoring import lm_scores
from docuforge.llm.substring_dedup import substring_dedup
from docuforge.llm.suffix_dedup import suffix_dedup

from .conftest import docs

WORDS = [f"w{i}" for i in range(300)]


def corpus(seed=1, n=30):
    """Texts that share passages of many lengths, with odd white space, repeated rows, nulls and empty texts."""
    r = random.Random(seed)
    passages = [" ".join(r.choices(WORDS, k=k)) for k in (20, 49, 50, 51, 75, 120, 300)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "a\u00a0b \x1c c\x0bd"), (4, "same " * 130), (5, "same " * 60)]
    for i in range(6, 6 + n):
        parts = [" ".join(r.choices(WORDS, k=r.choice((0, 3, 30, 80))))]
        for _ in range(r.randrange(3)):
            parts += [r.choice(passages), "".join(r.choices(" \n\t", k=2)).join(r.choices(WORDS, k=r.choice((1, 10, 40))))]
        out.append((i, " ".join(parts)))
    out += [(7, out[7][1]), (90, out[8][1]), (91, "é" * 150 + out[9][1]), (92, "é" * 150)]
    return out


def windows(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def check_substrings(spark, rows):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for x in windows(w, 50):
            first[x] = min(i, first.get(x, i))
    wanted = []
    for i, w in words:
        gone = [False] * len(w)
        for s, x in enumerate(windows(w, 50)):
            if first[x] < i:
                gone[s : s + 50] = [True] * 50
        wanted.append((i, len(w), sum(gone), b" ".join(a for a, g in zip(w, gone) if not g).decode()))
    found = [tuple(r)[:4] for r in substring_dedup(docs(spark, rows), carry=True).collect()]
    assert sorted(found) == sorted(wanted)
    assert sum(n for _, _, n, _ in wanted) > 500


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, small_segments, seed):
    check_substrings(spark, corpus(seed))


def test_substrings_of_odd_tables(spark, small_segments):
    passage = " ".join(WORDS[:60])
    assert substring_dedup(docs(spark, [])).count() == 0
    rows = {r.doc_id: r.n_removed for r in substring_dedup(docs(spark, [(None, passage), (5, passage), (5, passage)])).collect()}
    assert rows == {None: 60, 5: 0}


def check_suffixes(spark, rows):
    rows = [*rows, (200, "ab" * 500), (201, "z" * 199), (202, "z" * 199 + "y"), (203, "q" * 200), (204, None)]
    texts, n = [(i, (t or "").encode()) for i, t in rows], 200
    count = Counter(x[s : s + n] for _, x in texts for s in range(len(x) - n + 1))
    wanted = []
    for i, x in texts:
        gone = bytearray(len(x))
        for s in range(len(x) - n + 1):
            if count[x[s : s + n]] > 1:
                gone[s : s + n] = b"\1" * n
        wanted.append((str(i), len(x), sum(gone), len([p for p in bytes(gone).split(b"\0") if p]), bytes(c for c, g in zip(x, gone) if not g)))
    found = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(docs(spark, rows)).collect()]
    assert sorted(found) == sorted(wanted)
    assert sum(w[2] for w in wanted) > 2000 and suffix_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes(spark, small_segments, seed):
    check_suffixes(spark, corpus(seed))


def check_scores(spark, rows):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    c = Counter(g for _, w in texts for n in (1, 2, 3) for g in windows(w, n))
    total = sum(len(w) for _, w in texts)
    wanted = []
    for i, w in texts:
        score = 0.0
        for j in range(len(w)):
            penalty = 0.0
            for n in (3, 2, 1):
                if j + 1 < n:
                    continue
                g = tuple(w[j + 1 - n : j + 1])
                if n == 1:
                    score += penalty + math.log(c[g] / total)
                elif c[g] >= 2:
                    score += penalty + math.log(c[g] / c[g[:-1]])
                    break
                else:
                    penalty += math.log(0.4)
        wanted.append((i, len(w), round(score, 6)))
    found = lm_scores(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_tokens, round(r.log_score, 6)) for r in found) == sorted(wanted)
    assert all((r.mean_log_score is None) == (r.n_tokens == 0) for r in found)
    assert lm_scores(docs(spark, [])).count() == 0


def test_lm_scores(spark, small_segments):
    check_scores(spark, corpus(3))


@pytest.mark.parametrize("check", [check_substrings, check_suffixes, check_scores])
def test_very_long_texts(spark, check):
    """A text of 30,000 words, the same again, one that differs in a few words, and short ones that repeat parts of it."""
    r = random.Random(4)
    long = r.choices(WORDS, k=30_000)
    changed = [*long]
    for i in r.sample(range(30_000), 40):
        changed[i] = "other"
    parts = [(500 + i, " ".join(long[a : a + 90])) for i, a in enumerate((0, 14_000, 29_910))]
    check(spark, [*corpus(5, 5), (400, " ".join(long)), (401, " ".join(long)), (402, " ".join(changed)), (403, "one" * 30_000), *parts])


@pytest.mark.parametrize("check", [check_substrings, check_suffixes, check_scores])
def test_many_equal_rows(spark, check):
    """Repeated rows, ids included, share one segment; each keeps its own result."""
    check(spark, [*corpus(6, 5), *[(600, " ".join(WORDS[:70]))] * 3000, *[(601, " ".join(WORDS[:60]))] * 20])


@pytest.mark.parametrize("check", [check_substrings, check_suffixes, check_scores])
def test_equal_rows_that_outweigh_a_segment(spark, monkeypatch, check):
    """Such rows are dealt to all segments, those without text too; each keeps its own result."""
    monkeypatch.setattr("docuforge.llm.exchange.SEGMENT_BYTES", 3000)
    same = " ".join(WORDS[:60])
    check(spark, [*corpus(6, 5), *[(601, "")] * 60, *[(602, None)] * 60, *[(603, same)] * 40, *[(604, same)] * 40])


def test_a_third_of_the_rows_equal(spark, monkeypatch):
    """The deal keeps every segment near its volume and is the same in every pass."""
    from docuforge.llm import exchange as X
    from docuforge.llm.common import Scratch

    monkeypatch.setattr(X, "SEGMENT_BYTES", 20_000)
    table = spark.range(30_000).selectExpr("if(id % 3 = 0, -1, id) doc_id", "if(id % 3 = 0, repeat('word ', 20), repeat(cast(id as string), 20)) text")
    deal = X.Deal(table, "doc_id", "text", Scratch(spark, "deal"))
    sizes = [dict(deal.rows.groupBy("_seg").count().collect()) for _ in range(2)]
    assert sizes[0] == sizes[1] and sum(sizes[0].values()) == 30_000
    assert max(sizes[0].values()) < 2 * 30_000 / deal.segments
