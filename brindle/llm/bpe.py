"""Byte-level BPE, encoding and decoding, with a contiguous rank array for each short word.

A word is cut at every byte. One array holds the ids of its parts, a second the merge ranks of neighbouring parts; the
smallest rank is found by a scan, the boundary between its parts is deleted and the two ranks beside it are refreshed.
The new words of a group of texts are taken together: their arrays are the columns of a matrix, and a step merges once
in every word. Words above long_word bytes, where scans would cost the square of the length, use a heap of the same
ranks. What lies between single spaces is encoded once and remembered: after each group, a memory with more than a number
of pieces loses its older half and the pieces above 64 characters, and all of it goes when the partition ends.

Defined results: a null or empty text has no ids and decodes to an empty text; special tokens that stand in a text
become their own id; null ids stay null; repeated rows give repeated results, each its own; an empty table gives an
empty result; a text of any length is encoded whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from brindle.llm.common import give_back, text_groups, text_table

#: The published pre-tokenisation pattern of this vocabulary, and Unicode's white space.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_PRETOKEN = regex.compile(PRETOKENS)
_BESIDE = re.compile(f"^ | $| [{SPACES}]|[{SPACES}] ")
_CUT = re.compile(f"(?<=[^{SPACES}]) (?=[^{SPACES}])")
_NEVER = 1 << 60
_PLACE = 10
_MARKS = frozenset(".,;:!?")
#: One run of Latin letters, then one of other ASCII characters, without digits and apostrophes.
_RUN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b if b in plain else 256 + other.index(b)) for b in range(256)]


class RankBPE:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str, remember: int = 150_000, long_word: int = 400):
        spec = json.loads(open(path, encoding="utf-8").read())
        vocab, letters = spec["model"]["vocab"], byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.byte_id = [vocab[c] for c in letters]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for at, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = (at, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.piece = np.full(size, b"", object)
        for token, at in vocab.items():
            self.piece[at] = bytes(of_letter[c] for c in token)
        for token, at in self.special.items():
            self.piece[at] = token.encode()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = np.array(list(self.rank), np.int64).reshape(-1, 2)
        keys, found = pairs @ np.array([size + 1, 1]), np.array(list(self.rank.values()), np.int64).reshape(-1, 2)
        order = np.argsort(keys)
        self.size, self.keys, self.key_rank = size, np.append(keys[order], np.iinfo(np.int64).max), np.append(found[order, 0], 0)
        self.merged = np.zeros(len(keys) + 1, np.int64)
        self.merged[found[:, 0]] = found[:, 1]
        self.of_byte = np.array([*self.byte_id, size], np.int64)
        self.remember, self.long_word = remember, min(long_word, (1 << _PLACE) - 1)
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.long_words: list[str] = []

    def word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        return np.frombuffer(self.encode_words([raw])[0], "<u4").tolist()

    def encode_words(self, raws: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, each as little-endian unsigned 32-bit integers."""
        out = [b""] * len(raws)
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        for i in np.flatnonzero(lengths > self.long_word).tolist():
            out[i] = np.array(self._long(raws[i]), "<u4").tobytes()
        order = np.argsort(lengths, kind="stable")
        order = order[: int((lengths <= self.long_word).sum())]
        start = 0
        while start < len(order):  # words of about one length, up to 65,536 places of a matrix
            stop = min(len(order), start + 4096)
            stop = start + max(1, min(stop - start, (1 << 16) // int(lengths[order[stop - 1]] + 1)))
            some = order[start:stop].tolist()
            for i, ids in self._together(some, [raws[i] for i in some]):
                out[i] = ids
            start = stop
        return out

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, moved up by the bits of a place."""
        key = a * (self.size + 1) + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_rank[at] << _PLACE, _NEVER)

    def _together(self, names: list[int], raws: list[bytes]):
        """(name, ids) of words: one column for each. Ranks have their place in the low bits, so the least is the leftmost one of the smallest rank."""
        n, lengths = np.array(names), np.fromiter(map(len, raws), np.int64, len(raws))
        width = int(lengths.max(initial=0)) + 1  # the last part is none
        flat = np.frombuffer(b"".join(raws) + b"\0", np.uint8)
        at = np.arange(width)[:, None]
        place = (np.cumsum(lengths) - lengths) + np.minimum(at, lengths)
        ids = self.of_byte[np.where(at < lengths, flat[place], 256)]
        ranks = self._ranked(ids[:-1], ids[1:]) + at[:-1]
        while len(n):
            best = ranks.min(0) if len(ranks) else np.full(len(n), _NEVER)
            more = best < _NEVER >> 1
            if not more.all():
                last, size = ids[:, ~more], lengths[~more]
                got = last.T[np.arange(len(last)) < size[:, None]].astype("<u4").tobytes()
                ends = (np.cumsum(size) * 4).tolist()
                yield from zip(n[~more].tolist(), (got[a:b] for a, b in zip([0, *ends], ends)))
                n, lengths, ids, ranks, best = n[more], lengths[more], ids[:, more], ranks[:, more], best[more]
                if not len(n):
                    return
            i, columns = best & ((1 << _PLACE) - 1), np.arange(len(n))
            new = self.merged[best >> _PLACE]
            at = np.arange(len(ids) - 1)[:, None]
            ids = np.where(at <= i, ids[:-1], ids[1:])
            ids[i, columns] = new
            ranks = np.where(at[:-1] < i, ranks[:-1], ranks[1:] - 1)
            lengths = lengths - 1
            left, right = np.flatnonzero(i > 0), np.flatnonzero(i < lengths - 1)
            j = i[left]
            ranks[j - 1, left] = self._ranked(ids[j - 1, left], new[left]) + j - 1
            j = i[right]
            ranks[j, right] = self._ranked(new[right], ids[j + 1, right]) + j
            # the last part has nothing behind it
            end = np.flatnonzero((i == lengths - 1) & (i < len(ranks)))
            ranks[i[end], end] = _NEVER

    def _long(self, raw: bytes) -> list[int]:
        n = len(raw)
        ids, after, before, gone = [self.byte_id[b] for b in raw], [*range(1, n), -1], [*range(-1, n - 1)], [False] * n
        heap = [(*self.rank[pair], i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in self.rank]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = new, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (pair := (ids[x], ids[y])) in self.rank:
                    heapq.heappush(heap, (*self.rank[pair], x, *pair))
        return [x for x, dead in zip(ids, gone) if not dead]

    def _learn(self, known: dict[str, bytes], space: str, new: list[str]) -> None:
        """Remembers pieces that stand behind space. Most are one run of letters, perhaps with marks behind it."""
        cut, run = [], _RUN.fullmatch
        for p in new:
            letters = p[:-1] if p[-1] in _MARKS else p
            if letters.isascii() and letters.isalpha():
                cut.append((space + letters,) if letters is p else (space + letters, p[-1]))
            elif m := run(p):
                letters, marks = m.groups()
                cut.append((space + letters, marks) if marks else (space + letters,))
            else:
                cut.append(_PRETOKEN.findall(space + p))
        words = self.words
        if missing := list(set(chain.from_iterable(cut)).difference(words)):
            words.update(zip(missing, self.encode_words([w.encode() for w in missing])))
            self.long_words += [w for w in missing if len(w) > 64]
        known.update(zip(new, [words[c[0]] if len(c) == 1 else b"".join(map(words.__getitem__, c)) for c in cut]))

    def _bound(self, known: dict[str, bytes], new: list[str]) -> None:
        for p in new:
            if len(p) > 64:
                known.pop(p, None)
        if len(known) > self.remember:
            for old in list(islice(known, len(known) - self.remember // 2)):
                del known[old]

    def forget(self) -> None:
        """Empties what was remembered of texts."""
        self.first, self.later, self.words = {}, {}, {}
        give_back()

    def encode(self, text: str) -> bytes:
        """encode_all() of one text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. No token spans a single space between two other characters, so texts are cut there."""
        cut: list[list[str | list[str]]] = []  # of each text: special tokens, and lists of pieces
        for text in texts:
            pieces = self.split_special.split(text or "") if self.split_special else [text or ""]
            cut.append([p if at % 2 else _CUT.split(p) if _BESIDE.search(p) else p.split(" ") for at, p in enumerate(pieces) if p])
        lists = [x for c in cut for x in c if isinstance(x, list)]
        first, later = {x[0] for x in lists}, set(chain.from_iterable(x[1:] for x in lists))
        first, later = list(first.difference(self.first)), list(later.difference(self.later))
        self._learn(self.first, "", first)
        self._learn(self.later, " ", later)
        starts, get = self.first, self.later.__getitem__
        out = []
        for c in cut:
            got = []
            for x in c:
                if isinstance(x, str):
                    got.append(self.special[x].to_bytes(4, "little"))
                else:
                    got.append(starts[x[0]])
                    got += map(get, x[1:])
            out.append(b"".join(got))
        self._bound(self.first, first)
        self._bound(self.later, later)
        self._bound(self.words, self.long_words)
        self.long_words = []
        return out

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        at = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.asarray(ids)
        return b"".join(self.piece[at].tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> RankBPE:
    """One coder for each vocabulary in a worker."""
    return RankBPE(path)


def encode_texts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens. A map over the rows, without a shuffle. path: where every worker finds the vocabulary."""

    def run(batches):
        bpe = coder(path)
        for batch, texts in text_groups(batches):
            ids = bpe.encode_all(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])
        bpe.forget()

    return text_table(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens, text (decoded) of the rows of encode_texts()."""

    def run(batches):
        bpe = coder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [bpe.decode(x or b"") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "n_tokens", "text"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(run, "doc_id long, ids binary, n_tokens long, text string")


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, text: encode_texts() and decode_ids() in one pass, so a task needs one Python worker and one vocabulary."""

    def run(batches):
        bpe = coder(path)
        for batch, texts in text_groups(batches):
            ids = bpe.encode_all(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "n_tokens", "text"])
        bpe.forget()

    return text_table(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, n_tokens long, text string")
