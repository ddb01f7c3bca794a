"""Token counts of whole texts with overlap resynchronisation for huge documents.

Ordinary texts are cut at ASCII white space, where the tokenizer always splits
too, and the distinct pieces of a batch are encoded.  A huge text is encoded in
overlapping chunks, with offsets.  Two neighbouring encodings are spliced at a
boundary both agree on and that is proven stable, inside the overlap and with the same tokens on
both sides of it: white space that no token spans, or two characters that the
splitter never leaves in one piece, such as a letter and a full stop.  The tokenizer
splits there before it merges, so what stands left of
such a boundary never changes the tokens right of it.  Where no boundary of an
overlap is proven, the overlap is doubled, at last to the rest of the text; text that is one
unbroken run of letters is one piece to the tokenizer, and is encoded in one call.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_loaded: dict[str, object] = {}
#: Counts of pieces between white space that a worker remembers; it starts anew when they are so many.
REMEMBERED = 1 << 18


def load(path: str):
    """The tokenizer of a .json file, once per worker process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _spans(tokenizer, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    e = tokenizer.encode(text[start:end], add_special_tokens=False)
    return [(i, a + start, b + start) for i, (a, b) in zip(e.ids, e.offsets)]


@lru_cache(maxsize=1 << 16)
def _apart(tokenizer, x: str, y: str) -> bool:
    """Whether normalizer and splitter treat ``x`` and ``y`` apart wherever they stand side by side.

    The splitter knows runs of letters, single numbers, runs of other signs, and
    endings after an apostrophe; so but for the apostrophe, two characters that it parts by themselves
    are of different kinds, or numbers, and it parts them everywhere.  Marks and Hangul vowels and finals are left out as
    ``y``: only these compose with, or change places with, what precedes them.
    """
    if unicodedata.category(y)[0] == "M" or "\u1160" <= y <= "\u11ff":
        return False
    normal = tokenizer.normalizer.normalize_str
    left, both = normal(x), normal(x + y)
    if not left or left[-1] == "'" or both != left + normal(y):
        return False
    return any(a == len(left) for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(both))


@lru_cache(maxsize=1 << 10)
def _is_space(tokenizer, c: str) -> bool:
    return tokenizer.normalizer.normalize_str(c) == " "


@lru_cache(maxsize=8)
def _special(tokenizer) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def _stable(tokenizer, text: str, before: int, at: int) -> bool:
    """Whether the tokens from ``at`` on depend on nothing before it; the token in front ends at ``before``."""
    if before < at:
        return any(_is_space(tokenizer, c) for c in text[before:at])
    # A special string is found before anything is split.
    return _apart(tokenizer, text[at - 1], text[at]) and not any(s in text[max(0, at - len(s) + 1) : at + len(s) - 1] for s in _special(tokenizer))


def _meet(tokenizer, text: str, left: list, right: list, lo: int, hi: int, margin: int) -> tuple[int, int] | None:
    """Positions in ``left`` and ``right`` after which both go on equally, at a stable boundary inside [lo + margin, hi - margin]."""
    starts: dict[int, int] = {}
    for k, (_, a, _) in enumerate(right):
        starts.setdefault(a, k)  # several tokens may stand for one character
    for k in range(len(left) - 1, 0, -1):
        i, a, b = left[k]
        if a < lo + margin:
            return None
        j = starts.get(a)
        if j is None or j == 0 or b > hi - margin or right[j] != left[k] or right[j - 1] != left[k - 1]:
            continue
        before = left[k - 1][2]
        if before <= a and _stable(tokenizer, text, before, a):
            return k, j
    return None


def count_huge(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """The number of tokens of ``text`` from encodings of at most about ``chunk`` characters each."""
    end = min(chunk, len(text))
    held, total, base = _spans(tokenizer, text, 0, end), 0, 0
    while end < len(text):
        width = overlap
        while True:
            lo = max(0, end - width)
            stop = min(len(text), max(end + width, lo + chunk))
            # Nothing to splice on in all that is held: encode it again with as much text again, from its proven start.
            if lo <= base:
                stop = min(len(text), max(stop, 2 * end - base))
                held, end = _spans(tokenizer, text, base, stop), stop
                break
            right = _spans(tokenizer, text, lo, stop)
            met = _meet(tokenizer, text, held, right, lo, end, min(16, width // 4))
            if met:
                total, held, end = total + met[0], right[met[1] :], stop
                base = held[0][1]
                break
            width *= 2
    return total + len(held)


def _learn(tokenizer, memo: dict[bytes, int], pieces: set[bytes]) -> dict[bytes, int]:
    """A memo that has the token counts of all ``pieces``."""
    new = pieces - memo.keys()
    if len(memo) + len(new) > REMEMBERED:
        memo, new = {}, pieces
    new = list(new)
    for i in range(0, len(new), 8192):
        part = new[i : i + 8192]
        memo.update(zip(part, map(len, tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False))))
    return memo


def token_counts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk: int = 1 << 15, overlap: int = 1 << 10
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole text.

    Counts are those of the tokenizers library without begin, end or added
    special tokens; special strings inside a text are handled as the library does by
    default.  ``tokenizer_path`` must be readable on every executor.  Texts
    above ``chunk`` characters take the splicing way.  Null and empty texts
    count 0 bytes and 0 tokens; repeated rows give repeated rows.
    """

    def run(batches):
        tokenizer, memo = load(tokenizer_path), {}
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts = [0] * len(texts)
            small, held = [], 0
            for i, x in enumerate(texts):
                if len(x) > chunk:
                    counts[i] = count_huge(tokenizer, x, chunk, overlap)
                elif x:
                    small.append((i, x.encode().split()))  # bytes split at ASCII white space only
                    held += len(x)
                if held > 1 << 20 or i == len(texts) - 1:  # a bounded number of pieces at a time
                    memo = _learn(tokenizer, memo, set().union(*(pieces for _, pieces in small)))
                    for k, pieces in small:
                        counts[k] = sum(map(memo.__getitem__, pieces))
                    small, held = [], 0
            sizes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
