"""Token-id files with Elias-Fano document boundaries.

A file is a Parquet data set whose rows are blocks: the concatenated ids of up to max_docs documents (2 bytes each
where every id fits, else 4), and two Elias-Fano sequences, the documents' ends and the documents' own ids: the low bits
packed, the high parts in unary, and a select directory with one count for every 512 bits. No table of 64-bit offsets
or ids is kept; a block has its place, its smallest and its largest id, by which single documents are found. Blocks are
rows, so they are written and read by Spark on any store.

Documents stand in ascending doc_id order, null ids first, ties by a hash of their texts. A null or empty text holds
the end id alone; repeated rows are kept, each with its own place; an empty table makes an empty file; texts of any
length are encoded whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import text_groups, text_table

_SEQUENCE = ["low_bits", "low", "high", "directory"]
_BLOCK_ARROW = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int32()), ("n_null", pa.int32()), ("n_ids", pa.int64()), ("id_bytes", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64())]
    + [(f"{which}_{name}", pa.int32() if name == "low_bits" else pa.binary()) for which in ("ends", "docs") for name in _SEQUENCE]
    + [("ids", pa.binary())]
)
_BLOCK = ", ".join(f"{f.name} {({pa.int32(): 'int', pa.int64(): 'long'}).get(f.type, 'binary')}" for f in _BLOCK_ARROW)
_STRIDE = 512


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(largest / length) bits an entry."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, directory: bytes):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, int(v[-1] // n).bit_length() - 1)
        low = np.packbits(((v[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8), bitorder="little").tobytes()
        ones = (v >> low_bits) + np.arange(n)
        bits = np.zeros(-(-(int(ones[-1]) + 1) // _STRIDE) * _STRIDE, np.uint8)
        bits[ones] = 1
        directory = np.concatenate([[0], np.cumsum(bits.reshape(-1, _STRIDE).sum(1))[:-1]]).astype("<u4")
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), directory.tobytes())

    def select(self, which: np.ndarray) -> np.ndarray:
        """Places of the given ones (from 0) in the high bits: the directory gives the stride, popcounts the byte, a scan the bit."""
        high, ranks = np.frombuffer(self.high, np.uint8), np.frombuffer(self.directory, "<u4")
        which = np.asarray(which, np.int64)
        stride = np.searchsorted(ranks, which, side="right") - 1
        step = _STRIDE // 8
        counts = np.bitwise_count(high).reshape(-1, step)[stride].cumsum(1)
        left = which - ranks[stride]
        byte = (counts <= left[:, None]).sum(1)
        left = left - np.where(byte > 0, counts[np.arange(len(which)), np.maximum(byte - 1, 0)], 0)
        at = stride * step + byte
        inside = np.unpackbits(high[at][:, None], axis=1, bitorder="little").cumsum(1)
        return at * 8 + (inside <= left[:, None]).sum(1)

    def get(self, which: np.ndarray) -> np.ndarray:
        """The entries at the given places."""
        which = np.asarray(which, np.int64)
        upper = self.select(which) - which
        low = np.zeros(len(which), np.int64)
        packed = np.frombuffer(self.low, np.uint8)
        for i in range(self.low_bits):
            bit = which * self.low_bits + i
            low |= ((packed[bit >> 3] >> (bit & 7)) & 1).astype(np.int64) << i
        return (upper << self.low_bits) | low


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class CachedEncoder:
    """Ids by the tokenizers library, where the vocabulary drops white space and marks the ends of words with </w>.

    No token reaches over a space or line feed, so what lies between is encoded once and remembered. Most of it is one
    run of letters, perhaps with punctuation behind it: new runs are encoded in one call, lower-cased as the vocabulary
    does, and its ids are cut at the word ends. Both memories are bounded: remember pieces and remember_runs letter runs,
    about 200 bytes each.
    """

    #: Letters that normalisation leaves single letters, then punctuation but the apostrophe.
    RUN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)")

    #: The marks that stand behind most of them.
    MARKS = frozenset(".,;:!?")

    def __init__(self, path: str, remember: int = 650_000, remember_runs: int = 1_100_000):
        self.tokenizer, self.remember, self.remember_runs, self.known, self.runs = _tokenizer(path), remember, remember_runs, {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.size = np.zeros(len(self.ends), np.int64)  # bytes of each token: the vocabulary has a letter for a byte
        for t, i in vocabulary.items():
            self.size[i] = len(t.removesuffix("</w>"))
        self.marks = {"": b""}

    def _encoded(self, text: str) -> np.ndarray:
        """Ids of a text, by the library's way that keeps no offsets."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _ids(self, text: str) -> bytes:
        return self._encoded(text).tobytes()

    def _learn_runs(self, new: list[str]) -> None:
        ids = self._encoded(" ".join(new))
        stops = np.flatnonzero(self.ends[ids]) + 1
        size = np.concatenate([[0], np.cumsum(self.size[ids])])[stops]
        # every run must end where its bytes end
        if len(stops) == len(new) and (size == np.cumsum(np.fromiter(map(len, map(str.encode, new)), np.int64, len(new)))).all():
            flat, cuts = ids.tobytes(), stops.tolist()
            self.runs.update(zip(new, [flat[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts)]))
        else:
            self.runs.update((x, self._ids(x)) for x in new)

    def _learn(self, new: list[str]) -> None:
        plain, behind, other, marks, match = [], [], [], self.MARKS, self.RUN.fullmatch  # plain: pieces of ASCII letters, by the mark behind them
        by_mark: dict[str, list[str]] = {"": plain}
        for p in new:
            s = p[:-1] if p[-1:] in marks else p
            if s.isascii() and s.isalpha():
                plain.append(p) if s is p else by_mark.setdefault(p[-1], []).append(s)
            elif m := match(p):
                behind.append((p, m[1].lower(), m[2]))
            else:
                other.append(p)
        if len(self.runs) > self.remember_runs:
            self.runs.clear()
        if len(self.marks) > 10_000:
            self.marks = {"": b""}
        lower = {mark: "\n".join(some).lower().split("\n") if some else [] for mark, some in by_mark.items()}
        if missing := list(set(chain(*lower.values(), (s for _, s, _ in behind))).difference(self.runs)):
            self._learn_runs(missing)
        runs, known = self.runs, self.known
        self.marks.update((m, self._ids(m)) for m in {*by_mark, *(m for _, _, m in behind)}.difference(self.marks))
        for mark, some in by_mark.items():
            ids = map(runs.__getitem__, lower[mark])
            if mark:
                end = self.marks[mark]
                known.update(zip([s + mark for s in some], [i + end for i in ids]))
            else:
                known.update(zip(some, ids))
        for p, s, m in behind:
            known[p] = runs[s] + self.marks[m]
        known.update((p, self._ids(p)) for p in other)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        if len(self.known) > self.remember:  # what is in use now stays
            self.known = {p: self.known[p] for p in set(chain.from_iterable(parts)).intersection(self.known)}
        known = self.known
        got = [list(map(known.get, text)) for text in parts]
        missing = [[i for i, x in enumerate(ids) if x is None] for ids in got]
        if new := {text[i] for text, at in zip(parts, missing) for i in at}:
            self._learn(list(new))
        for text, ids, at in zip(parts, got, missing):
            for i in at:
                ids[i] = known[text[i]]
        return [b"".join(ids) for ids in got]


@lru_cache(maxsize=2)
def _encoder(path: str) -> CachedEncoder:
    return CachedEncoder(path)


def _block(part: int, block: int, before: int, ids: list[bytes], doc_ids: list[int | None]) -> pa.RecordBatch:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<u4")
    small = not len(flat) or int(flat.max()) < 1 << 16
    known = [i for i in doc_ids if i is not None]
    first, last = (known[0], known[-1]) if known else (None, None)
    sequences = [EliasFano.of(np.cumsum(lengths)), EliasFano.of(np.array([i - first for i in known], np.int64))]
    row = [part, block, before, len(ids), len(ids) - len(known), len(flat), 2 if small else 4, first, last]
    row += [getattr(ef, name) for ef in sequences for name in _SEQUENCE]
    row.append(flat.astype("<u2").tobytes() if small else flat.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK_ARROW)], schema=_BLOCK_ARROW)


def _sequences(row: dict) -> tuple[EliasFano, EliasFano]:
    """Ends and ids (less the first) of a block."""
    ends, docs = ([row[f"{which}_{name}"] for name in _SEQUENCE] for which in ("ends", "docs"))
    return EliasFano(row["n_docs"], *ends), EliasFano(row["n_docs"] - row["n_null"], *docs)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 1024, max_ids: int = 1 << 20) -> None:
    """Encodes every text with the tokenizer file vocabulary, adds end_id, and writes blocks to path in ascending id order.

    One range shuffle of the texts; a task streams its range and holds one block at a time.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = _encoder(vocabulary)
        part = TaskContext.get().partitionId()
        block, before, size, ids, doc_ids = 0, 0, 0, [], []
        for batch, texts in text_groups(batches, limit=2_000_000):
            for doc_id, got in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                if doc_id is not None and doc_ids and doc_ids[-1] is not None and doc_id - next(i for i in doc_ids if i is not None) >= 1 << 62:
                    yield _block(part, block, before, ids, doc_ids)
                    block, before, size, ids, doc_ids = block + 1, before + size, 0, [], []
                ids.append(got + end)
                doc_ids.append(doc_id)
                size += len(got) // 4 + 1
                if len(ids) >= max_docs or size >= max_ids:
                    yield _block(part, block, before, ids, doc_ids)
                    block, before, size, ids, doc_ids = block + 1, before + size, 0, [], []
        if ids:
            yield _block(part, block, before, ids, doc_ids)

    rows = text_table(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))  # rows of one id, or without, are spread too
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(run, _BLOCK).write.option("compression", "lz4_raw").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit) of a file.

    Only one number for each written part goes through the driver.
    """
    blocks = spark.read.schema(_BLOCK).parquet(path)
    offsets, total = {}, 0
    for row in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toLocalIterator():
        offsets[row["part"]] = total
        total += row["n"]

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ef, docs = _sequences(row)
                ends = ef.get(np.arange(ef.n))
                doc_ids = [None] * row["n_null"] + [row["first_id"] + int(x) for x in docs.get(np.arange(docs.n))]
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                flat = np.frombuffer(row["ids"], f"<u{row['id_bytes']}").astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + offsets[row["part"]] + row["before"]), pa.array(ends - starts), pa.array([flat[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], schema=schema)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")



def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, n_tokens, ids of the documents with the given ids (a list that fits the driver). Only blocks whose range of ids holds one are read, and of them only its ends are decoded."""
    wanted = np.array(sorted(set(doc_ids)), np.int64)
    blocks = spark.read.schema(_BLOCK).parquet(path)
    among = [F.col("first_id") <= int(i) for i in wanted[-1:]] + [F.col("last_id") >= int(i) for i in wanted[:1]]
    blocks = blocks.filter(among[0] & among[1]) if len(wanted) else blocks.limit(0)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                mine = wanted[(wanted >= row["first_id"]) & (wanted <= row["last_id"])]
                if not len(mine):
                    continue
                ef, docs = _sequences(row)
                held = docs.get(np.arange(docs.n)) + row["first_id"]
                at = np.flatnonzero(np.isin(held, mine)) + row["n_null"]
                stop, start = ef.get(at), np.where(at > 0, ef.get(np.maximum(at - 1, 0)), 0)
                flat = np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
                got = [flat[a:b].astype("<u4").tobytes() for a, b in zip(start, stop)]
                yield pa.RecordBatch.from_arrays([pa.array(held[at - row["n_null"]]), pa.array(stop - start), pa.array(got, pa.binary())], schema=schema)

    return blocks.mapInArrow(run, "doc_id long, n_tokens long, ids binary")
