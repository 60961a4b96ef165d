"""Benchmark decontamination: Aho-Corasick automata over normalised test questions and answers.

Every item becomes windows of normalised words. The windows go into one automaton (the pyahocorasick library's), and
each text is scanned once; matches are mapped back to code-point offsets of the original text. Only the items' texts are
sent to the tasks, which cut the windows themselves. A benchmark of more than max_chars characters becomes several
automata, each bounded, that the plan applies one after the other to the same rows; after every few of them the rows are
written, so a benchmark of any size works and no more than a few parts are held at once.

Defined results: a null or wordless text has no words and no hits; an item without words matches nothing; repeated rows
and null ids give their own results; a null item id is reported as an empty string; an empty table, or an empty
benchmark, gives no hits; texts of any length are scanned whole; other columns can be carried along, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import give_back, spans_of, text_groups, written

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_NORMAL = bytes(b if b in _WORD_BYTES else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_ORIGINAL_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_SCANNED = T.StructType().add("n_words", T.LongType()).add("runs", T.ArrayType(T.StructType().add("first", T.IntegerType()).add("last", T.IntegerType()))).add("items", T.ArrayType(T.StringType()))
_SUMMED = T.StructType().add("n_words", T.LongType()).add("n_hit", T.LongType()).add("item_ids", T.ArrayType(T.StringType())).add("spans", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())))
_ARROW_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_HELD = 8  # parts of a benchmark that are held at once


def normal_words(text: str | None) -> list[bytes]:
    """Words of 0-9, a-z (A-Z lower-cased) and bytes above ASCII."""
    return text.encode().translate(_NORMAL).split() if text else []


def _windows(words: list[bytes], k: int) -> Iterator[tuple[bytes, int]]:
    n = min(k, len(words))
    for i in range(len(words) - n + 1 if n else 0):
        yield b" ".join(words[i : i + n]), n


def _parts(benchmark: DataFrame, item_col: str, text_col: str, max_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in parts of about max_chars characters; one part at least."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    part, size = [], 0
    for row in items.filter(F.length("text") > 0).toLocalIterator():
        if part and size + len(row["text"]) > max_chars:
            yield part
            part, size = [], 0
        part.append((row["item"], row["text"]))
        size += len(row["text"])
    yield part


def _automaton(items: list[tuple[str, str]], k: int) -> tuple[ahocorasick.Automaton, list[list[str]]]:
    """An automaton whose values are (words of the window, its number), and the items of each window."""
    numbers: dict[bytes, int] = {}
    holders: list[list[str]] = []
    automaton = ahocorasick.Automaton()
    for item, text in items:
        for key, n in _windows(normal_words(text), k):
            at = numbers.setdefault(key, len(numbers))
            if at == len(holders):
                holders.append([])
                automaton.add_word(f" {key.decode('latin-1')} ", (n, at))
            if not holders[at] or holders[at][-1] != item:
                holders[at].append(item)
    if len(automaton):
        automaton.make_automaton()
    return automaton, holders


def _scanner(shared, k: int, width: int, carried: bool, last: bool):
    """width: how many columns come first and are passed on; the second is the text. carried: what earlier automata found follows. last: gives the summary instead."""

    def scan(batches):
        automaton, holders = _automaton(shared.value, k)
        for batch, texts in text_groups(batches):
            runs = batch.column(width + 1).to_pylist() if carried else [[]] * len(texts)
            known = batch.column(width + 2).to_pylist() if carried else [[]] * len(texts)
            counts, masks, items = [], [], []
            for text, before, names in zip(texts, runs, known):
                words = normal_words(text)
                counts.append(len(words))
                edges, hit = [(r["first"], r["last"] + 1) for r in before], set()
                if words and len(automaton):
                    ends = None
                    for end, (n, at) in automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
                        if ends is None:
                            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                        stop = int(np.searchsorted(ends, end)) + 1
                        edges.append((stop - n, stop))
                        hit.add(at)
                step = np.zeros(len(words) + 1, np.int64)
                if edges:
                    first, stop = np.array(edges, np.int64).T
                    np.add.at(step, first, 1)
                    np.add.at(step, stop, -1)
                masks.append(np.cumsum(step)[:-1] > 0)
                items.append(sorted({*names, *(item for at in hit for item in holders[at])}))
            if last:
                yield _summary(batch, width, texts, counts, masks, items)
            else:
                listed = [[{"first": int(a), "last": int(b) - 1} for a, b in zip(*spans_of(m))] for m in masks]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(counts, pa.int64()), pa.array(listed, _ARROW_RUNS), pa.array(items, pa.list_(pa.string()))], [*batch.schema.names[:width], "n_words", "runs", "items"])
        give_back()

    return scan


def _summary(batch: pa.RecordBatch, width: int, texts: list, counts: list[int], masks: list[np.ndarray], items: list[list[str]]) -> pa.RecordBatch:
    n_hit, spans = [int(m.sum()) for m in masks], []
    for text, mask, n in zip(texts, masks, n_hit):
        at = [m.span() for m in _ORIGINAL_WORD.finditer(text)] if n else []
        spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(*spans_of(mask))] if n else [])
    kept = [i for i in range(width) if i != 1]
    return pa.RecordBatch.from_arrays(
        [*[batch.column(i) for i in kept], pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
        [*[batch.schema.names[i] for i in kept], "n_words", "n_hit", "item_ids", "spans"],
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, k: int = 10, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_chars: int = 500_000, carry: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any benchmark window of k words), item_ids (sorted strings), spans (code points of the original, end exclusive), and the columns named in carry.

    Documents are neither shuffled nor joined; a part of at most about max_chars characters of the benchmark is one broadcast.
    """
    sc = docs.sparkSession.sparkContext
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    fields, width = out.schema.fields, len(out.columns)
    passed, summed = T.StructType(fields + _SCANNED.fields), T.StructType([f for f in fields if f.name != "text"] + _SUMMED.fields)
    parts = _parts(benchmark, item_col, item_text_col, max_chars)
    part, i = next(parts), 0
    while part is not None:
        after = next(parts, None)
        out = out.mapInArrow(_scanner(sc.broadcast(part), k, width, bool(i), after is None), summed if after is None else passed)
        part, i = after, i + 1
        if part is not None and i % _HELD == 0:
            out = written(out, "scanned")
    return out.select("doc_id", *_SUMMED.names, *[F.col(f"_carry_{c}").alias(c) for c in carry])
