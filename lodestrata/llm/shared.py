"""What several operators share: a shared workspace for written tables, and hashing of text in whole Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space, and tab to carriage return.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
WORD = r"[^\x20\x09-\x0D]+"

MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_IS_SEP = np.isin(np.arange(256), list(SEPARATORS))
_TABLE = np.random.default_rng(20240501).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Bytes of text hashed at a time: bounds the memory of a Python worker whatever the length of a text, and fits its cache.
CHUNK = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset and Spark runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("lodestrata.shared.dir", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            at = tempfile.mkdtemp(prefix="lodestrata-")
            spark.conf.set("lodestrata.shared.dir", at)
    return at


class Workspace:
    """Tables written below the shared folder, to cut lineage so that a lost executor costs one step at most."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/lodestrata-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false"}).parquet(path)
        self.free()
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Lets Spark delete the shuffle files of steps that are done, which it does when the driver's garbage goes."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shelter(docs: DataFrame, *used: str) -> DataFrame:
    """docs with the columns named in `used` and one struct of all others, whose names then can't clash with those that
    an operator needs on the way; sheltered() has them back."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*(c for c in docs.columns if c in used), *([F.struct(*rest).alias("sheltered")] if rest else []))


def sheltered(out: DataFrame, columns: list[str], used: tuple[str, ...], *results: str) -> DataFrame:
    """`columns` as they were before shelter(), but for those named in `results`, which follow."""
    own = [F.col(c) if c in used else F.col("sheltered").getField(c).alias(c) for c in columns if c not in results]
    return out.select(*own, *results)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, one after another, and where each starts and the last ends. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, most: int = CHUNK):
    """Ranges of rows with about `most` bytes each; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return _Powers, ()  # tables are made anew where they are needed

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            self.up = np.full(size, _P, np.uint64)
            self.down = np.full(size, _P_INV, np.uint64)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up, self.down


_powers = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every bit depends on all of the input."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over bytes, with a leading 0; span() makes hashes of any byte range of them."""
    up, _ = _powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def inverses(n: int) -> np.ndarray:
    """What a difference of prefix sums is multiplied with to be a hash, by where it starts."""
    return _powers.get(n)[1][:n]


def span(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _powers.get(len(sums))
    return (sums[ends] - sums[starts]) * down[starts]


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin. Texts longer than CHUNK are hashed piece by piece, cut between words."""
    hashes, counts = [], []
    for i, j in slices(offsets):
        at, end = int(offsets[i]), int(offsets[j])
        if j - i > 1 or end - at <= 2 * CHUNK:
            h, c = _words(data[at:end], offsets[i : j + 1] - at, fold)
            hashes.append(h)
            counts.append(c)
            continue
        n = 0
        while at < end:
            to = min(end, at + CHUNK)
            while to < end and not _IS_SEP[data[to]]:
                ahead = np.flatnonzero(_IS_SEP[data[to : to + CHUNK]])
                to = to + int(ahead[0]) if len(ahead) else min(end, to + CHUNK)
            h, c = _words(data[at:to], np.array([0, to - at]), fold)
            hashes.append(h)
            n += int(c[0])
            at = to
        counts.append(np.array([n]))
    out = np.zeros(len(offsets), np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=out[1:])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), out


def _words(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    if fold:
        data = _FOLD[data]
    inside = ~_IS_SEP[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return mix(span(prefix(data), starts, ends)), np.diff(np.searchsorted(starts, offsets))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` words, by where it starts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h *= np.uint64(_P)
        h += words[k : k + n]
    return mix(h)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The set of a text's shingles as sorted distinct hashes; a text with fewer words has one, the whole sequence; none without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    found = np.sort(windows(words, min(size, len(words))) + np.uint64(min(size, len(words))))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]
