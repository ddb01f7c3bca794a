"""Shared plumbing of the training-data operators: scratch tables, byte and word hashing.

Scratch tables are Parquet folders below ``spark.checkpoint.dir``, which every
executor can read, so a lost executor costs a re-read and never a recomputation
from the source.  The hashing helpers work on whole Arrow string buffers, so no
Python object is made per word.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes hashed at a time; bounds the numpy temporaries of a task to some tens of MB.
BLOCK_BYTES = 1 << 20
#: Rows of a file of a scratch table, where their number is known beforehand.
FILE_ROWS = 1 << 14

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where that is unset and everything runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docuforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/docuforge/{name}-{uuid.uuid4().hex}"
        _scratch.append((spark, self.root))

    def table(self, df: DataFrame, name: str, most: int | None = None) -> DataFrame:
        """Write ``df`` and read it back: cuts lineage and survives lost executors.

        A table known to have ``most`` rows at most is written in files of some size, not in one for each shuffle
        partition: without Hadoop's native library each new file starts a child of the executor.
        """
        path = f"{self.root}/{name}"
        if most is not None:
            df = df.coalesce(max(1, -(-most // FILE_ROWS)))
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps before the next step writes its own.

        The first round drops what Python holds of the plans, the second what the JVM held for it.
        """
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def _clean_up() -> None:
    for spark, root in _scratch:
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, root)
            except Exception:  # the JVM may already be gone at exit
                return


def partitions_for(spark: SparkSession, n: int) -> int:
    """Shuffle partitions for ``n`` groups: at least the session's own number, so that hot and huge inputs spread."""
    return max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 8)))


# --- hashing ---------------------------------------------------------------

_MASK = (1 << 64) - 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashing modulo 2^64 of runs of an array of already well-mixed 64-bit values."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self._pow = self._inv = np.empty(0, np.uint64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums S with S[0] = 0; ``between`` reads the hash of any run from them."""
        n = len(values)
        if len(self._pow) < n + 1:
            size = max(n + 1, 1 << 16)
            self._pow, self._inv = _powers(self.base, size), _powers(self.inverse, size)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self._pow[:n], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return splitmix((prefix[end] - prefix[start]) * self._inv[start])


#: 64-bit stand-ins of the 256 byte values.
BYTE_VALUES = splitmix(np.arange(256, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
#: The separators of ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_word_roll = Rolling(0x5851F42D4C957F2D)


def text_buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # several chunks remain only beyond 2 GB
            column = pa.concat_arrays(column.chunks)
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and the number of words of each document; words never cross documents."""
    n = len(raw)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = ~IS_SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begins[cut] = word[cut]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[cut - 1] = word[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(starts, offsets))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, computed block by block."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
        prefix = _word_roll.prefix(BYTE_VALUES[raw[base : ends[j - 1]]])
        out[i:j] = _word_roll.between(prefix, starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def doc_slices(counts: np.ndarray) -> np.ndarray:
    """Offsets of each document's items from the number of items of each."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def batches_of(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """Ranges of consecutive documents of at most ``most`` bytes together (one document at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def own(name: str):
    """A column by its name as it is, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(base: str, taken) -> str:
    """``base``, with underscores added until no name in ``taken`` equals it, in any case of letters."""
    used = {c.lower() for c in taken}
    while base.lower() in used:
        base += "_"
    return base
