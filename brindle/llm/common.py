"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return: what bytes.split() splits at.
WHITE = b" \t\n\x0b\x0c\r"
#: Texts are handled in groups of about this many bytes, so memory doesn't follow the Arrow batch.
GROUP_BYTES = 1_000_000


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="brindle-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, only a local session gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
    return (where or _own_dir()).rstrip("/")


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows of df, written once to the shared folder and read back, and their path: lineage ends here and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """written_at() without the path."""
    return written_at(df, name)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of written_at() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Returns freed memory of this worker to the machine; called when a partition ends, since workers are used again by other steps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only glibc has it
        pass


def text_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), whatever other columns df has."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_groups(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches with at most about limit bytes of text each (one row at least), with their texts."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        start, n = 0, batch.num_rows
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            part = batch.slice(start, stop - start)
            yield part, part.column(at).to_pylist()
            start = stop
        del batch
        pa.default_memory_pool().release_unused()


# ---------------------------------------------------------------- 64-bit hashes of words, many texts at once

_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_MULT, -1, 1 << 64)
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def power(which: str, n: int) -> np.ndarray:
    """The first n powers of the hash's base ("up") or of its inverse ("down")."""
    base, have = _MULT if which == "up" else _INVERSE, _powers.get(which)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _powers[which] = np.multiply.accumulate(out)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which near values go far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes between starts and ends; equal bytes have equal hashes wherever they stand."""
    n = len(data)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * power("up", n), dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * power("down", n)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without white space) of the texts in one array, and where each text's words begin (one entry more than texts)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    white = _IS_WHITE[data]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(data) and not white[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    if len(starts) > len(ends):
        starts = starts[:-1]
    hashes = span_hashes(data, starts, ends)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    return hashes, np.searchsorted(starts, begins)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out * np.uint64(_MULT)) ^ mixed(words[i : i + n] + np.uint64(i + 1))
    return mixed(out)


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    step = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
