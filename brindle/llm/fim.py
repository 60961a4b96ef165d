"""Fill-in-the-middle transformation with a Fenwick tree over text blocks.

A text is cut after two numbers of units, drawn from a hash of its id, and its parts are set in the order that trains
a model to fill the middle in. A unit is a word with the white space before it, or white space at the end. The bytes of
a text are taken in fixed blocks; a Fenwick tree holds the units that end and the code points that begin in each block.
Binary lifting descends the tree to the block of a cut and the code points before it; the boundary is then found inside
that block alone. So a cut costs the logarithm of the number of blocks, and one block.

The form: plain if the text is empty or holds a marker, or by chance; else spm or psm. As a text with a marker is never
cut, the markers of an output say exactly where its parts begin, and restore() puts them together again.

Defined results: a null text is empty; an id that is null is drawn for as an empty one; rows that share an id get the
same draw, each on its own text; texts of any length are handled whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm.common import WHITE, give_back, text_groups, text_table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 512  # bytes
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True


class BlockTree:
    """A text's units and code points by block of bytes, as two Fenwick trees that are descended together."""

    def __init__(self, data: bytes, block: int = BLOCK):
        self.block = block
        raw = np.frombuffer(data, np.uint8)
        white = _IS_WHITE[raw]
        last = np.ones(len(raw), bool)
        last[:-1] = white[1:]
        self.ends = ~white & last  # the last byte of a word
        if len(raw):
            self.ends[-1] = True  # of a word, or of the white space at the end
        self.begins = (raw & 0xC0) != 0x80  # the first byte of a code point
        at = np.arange(0, len(raw), block)
        self.size = len(at)
        self.units, self.points = (self._tree(np.add.reduceat(x, at, dtype=np.int64) if self.size else np.empty(0, np.int64)) for x in (self.ends, self.begins))
        self.n = int(self.ends.sum())

    @staticmethod
    def _tree(counts: np.ndarray) -> list[int]:
        """Entry i holds the sum of the (i & -i) blocks up to and with block i (from 1)."""
        sums = np.concatenate([[0], np.cumsum(counts)])
        i = np.arange(1, len(sums))
        return [0, *(sums[i] - sums[i - (i & -i)]).tolist()]

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points up to the end of so many units."""
        if units == 0:
            return 0, 0
        at, points, step = 0, 0, 1 << self.size.bit_length()
        while step:  # the last block before which fewer units end
            if at + step <= self.size and self.units[at + step] < units:
                at += step
                units -= self.units[at]
                points += self.points[at]
            step >>= 1
        start = at * self.block
        inside = int(np.flatnonzero(self.ends[start : start + self.block])[units - 1]) + 1
        return start + inside, points + int(self.begins[start : start + inside].sum())


def draws(doc_id: int | None, seed: str = "42") -> list[int]:
    """Four numbers under 2^32 from the sha256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def transform(text: str, doc_id: int | None, *, seed: str = "42", rate: int = 50, spm: int = 80, block: int = BLOCK) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), and the output. rate and spm are per cent."""
    data = text.encode()
    tree = BlockTree(data, block)
    a, b, chance, order = draws(doc_id, seed)
    if not data or chance % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return tree.n, "plain", None, None, text
    (p, p_chars), (m, m_chars) = (tree.cut(u) for u in sorted((a % (tree.n + 1), b % (tree.n + 1))))
    prefix, middle, suffix = data[:p].decode(), data[p:m].decode(), data[m:].decode()
    if order % 100 < spm:
        return tree.n, "spm", p_chars, m_chars - p_chars, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return tree.n, "psm", p_chars, m_chars - p_chars, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that transform() was given."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(first):
        raise ValueError(f"not a text of form {form}")
    one, rest = output[len(first) :].split(second)
    two, middle = rest.split(MIDDLE)
    return two + middle + one if form == "spm" else one + middle + two


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = "42", rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of every row: a map without a shuffle."""

    def run(batches):
        for batch, texts in text_groups(batches):
            ids = batch.column(0).to_pylist()
            n, form, prefix, middle, output = zip(*[transform(t or "", i, seed=seed, rate=rate, spm=spm) for i, t in zip(ids, texts)])
            columns = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        give_back()

    return text_table(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def restored(outputs: DataFrame) -> DataFrame:
    """The rows of fill_in_middle() with a column text, rebuilt from output and form alone."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in outputs.schema.fields if f.name != "text"]
    rows = outputs.select(*[f.name for f in outputs.schema.fields if f.name != "text"])

    def run(batches):
        for batch, texts in text_groups(batches, "output"):
            forms = batch.column(batch.schema.get_field_index("form")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([restore(o, f) for o, f in zip(texts, forms)], pa.string())], [*batch.schema.names, "text"])
        give_back()

    return rows.mapInArrow(run, ", ".join([*fields, "text string"]))
