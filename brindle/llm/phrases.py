"""Phrase collocations by SON partitioning: shards are mined completely at lowered support, then candidates are counted.

Rows are dealt to a few shards by a hash. A phrase that has the global support has, in one shard at least, the support
lowered by the shard's share of all words (else its counts would add up to less). So each shard is mined for all phrases
that reach its own support, level by level: pairs of locally frequent words (that also have the global support, known by then), then triples of
locally frequent pairs.
The union over the shards is the candidates, which are then counted in one scan of all rows, as strings, exactly. A
shard is spread over all tasks, so shards are few and their support stays above one, however large the corpus.

What a level hands to the next scan is a Bloom filter of fixed size (filter_bits): wrong hits only add candidates, and
a filter that is too full only prunes less. Counts are summed within a group of texts before any shuffle, so a phrase
that all documents hold is one entry a group. Most pairs of a group occur once in it, so entries don't travel as rows:
those with the same first bits of the hash (a bucket) are packed into one row, and Spark brings the rows of a bucket
together to be summed. At 30 GB a bucket of pairs has about a million entries of 10 bytes. Shards are mined on 60-bit
hashes of words, which only propose candidates; in the final count words are told apart by their bytes and phrases
by word numbers within a group, and by their bytes across groups.

The support of a phrase is also reached by its parts, so the counts that a score needs are among those of the candidates.

Defined results: a null text has no pieces; a null lang is und; an empty table, or no phrase with the support, gives an
empty result; repeated rows count each; words may be of any length; other columns are ignored. Nothing depends on ids.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import discard, give_back, mixed, span_hashes, text_groups, written_at

BLANKS, CUTS = b" \t", b".,;:!?\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK, _CUT = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[list(BLANKS)], _CUT[list(CUTS)] = True, True
_PROBES = 3
_GROUP = 2_000_000  # bytes of text that are counted at a time
_KEYS = 2_000_000  # hashes that a task gathers before it packs them
_BUCKET_BITS = 12  # hashes that are packed together become one row a bucket; a bucket is summed in one go
_PHRASE_BITS = 10  # the same for the phrases of a language and length, which a group of texts packs
_BITS = np.uint64(2**64 - 16)  # hashes have 60 bits: 12 are the bucket, 6 bytes travel


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes in lower case, which of them stand apart from words, where words begin and end, and whether word i + 1 stands in the piece of word i."""
    raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    cut = _CUT[raw]
    apart = _BLANK[raw] | cut
    edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    edge = edge if apart[0] else np.concatenate([[0], edge])
    starts, ends = edge[0::2][: len(edge) // 2], edge[1::2]
    piece = np.cumsum(cut)[starts]
    return raw, apart, starts, ends, piece[1:] == piece[:-1]


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(3) + mixed(b + np.uint64(1))) & _BITS


def _triple_hash(pair: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mixed(pair * np.uint64(5) + mixed(last + np.uint64(2))) & _BITS


class Phrases:
    """The words, pairs and triples of some texts that wanted (a test of hashes) lets pass: distinct ones with their counts, told apart exactly."""

    def __init__(self, texts: list[bytes], salt: int, wanted: Callable[[np.ndarray], np.ndarray]):
        raw, apart, starts, ends, follows = _words_of(texts)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~apart])]).dictionary_encode()
        ids = np.asarray(words.indices).astype(np.int64)
        self.dictionary, self.n, width = words.dictionary, len(ids), max(1, len(words.dictionary))
        of_word = self._hashes(salt)
        good = wanted(of_word)
        single = np.flatnonzero(good)
        at = np.flatnonzero(follows & good[ids[1:]] & good[ids[:-1]])
        pair = _pair_hash(of_word[ids[at]], of_word[ids[at + 1]])
        good = wanted(pair)
        at, pair = at[good], pair[good]
        key, first, number, pairs = np.unique(ids[at] * width + ids[at + 1], return_index=True, return_inverse=True, return_counts=True)
        pair_words = np.stack(np.divmod(key, width), 1)
        j = np.flatnonzero(at[1:] == at[:-1] + 1)
        last = ids[at[j] + 2]
        triple = _triple_hash(pair[j], of_word[last])
        good = wanted(triple)
        key, begin, triples = np.unique(number[j][good] * width + last[good], return_index=True, return_counts=True)
        front, last = np.divmod(key, width)
        #: By length: word numbers, hashes and counts.
        self.found = {
            1: (single[:, None], of_word[single], np.bincount(ids, minlength=width)[single]),
            2: (pair_words, pair[first], pairs),
            3: (np.concatenate([pair_words[front], last[:, None]], 1), triple[good][begin], triples),
        }

    def _hashes(self, salt: int) -> np.ndarray:
        if not self.n:
            return np.empty(0, np.uint64)
        _, offsets, data = self.dictionary.buffers()
        offsets = np.frombuffer(offsets, np.int32)[: len(self.dictionary) + 1].astype(np.int64)
        return mixed(span_hashes(np.frombuffer(data, np.uint8)[: offsets[-1]], offsets[:-1], offsets[1:]) ^ np.uint64(salt)) & _BITS

    def lines(self, words: np.ndarray) -> pa.Array:
        """Phrases, each joined by spaces and ended by a line feed, from rows of word numbers."""
        parts = [self.dictionary.take(pa.array(words[:, k])) for k in range(words.shape[1])]
        joined = pc.binary_join_element_wise(*parts, b" ") if len(parts) > 1 else parts[0]
        return pc.binary_join_element_wise(joined, b"", b"\n")


@lru_cache(maxsize=10_000)
def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little")


def _of_shard(hashes: np.ndarray, shard: np.ndarray) -> np.ndarray:
    return mixed(hashes + (shard + 1).view(np.uint64))


def _bits(keys: np.ndarray, filter_bits: int) -> list[np.ndarray]:
    return [(mixed(keys + np.uint64(k)) & np.uint64((1 << filter_bits) - 1)).astype(np.int64) for k in range(_PROBES)]


def has(bloom: np.ndarray, keys: np.ndarray, filter_bits: int) -> np.ndarray:
    """Which keys are in the filter, or seem to be."""
    out = np.ones(len(keys), bool)
    for at in _bits(keys, filter_bits):
        out &= (bloom[at >> 6] >> (at & 63)) & 1 == 1
    return out


def _filter_of(keys: DataFrame, filter_bits: int):
    """A broadcast of 2^filter_bits bits, in which the keys (columns shard, which may be null, and key) are set."""

    def run(batches):
        for batch in batches:
            key = np.asarray(batch.column(1)).view(np.uint64)
            shard = np.asarray(batch.column(0).fill_null(-1)).astype(np.int64)
            at = np.unique(np.concatenate(_bits(np.where(shard < 0, key, mixed(key + (shard + 1).view(np.uint64))), filter_bits)))
            if len(at):
                word, begin = np.unique(at >> 6, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bitwise_or.reduceat(np.left_shift(np.int64(1), at & 63), begin))], ["word", "bits"])

    rows = keys.select(F.col("shard").cast("int"), F.col("key").cast("long")).mapInArrow(run, "word long, bits long")
    table = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2^filter_bits / 64 rows at most
    bloom = np.zeros(1 << (filter_bits - 6), np.int64)
    bloom[np.asarray(table["word"])] = np.asarray(table["bits"])
    return keys.sparkSession.sparkContext.broadcast(bloom)


def _in_buckets(sorted_keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (first bits) of sorted keys that hold any, and where each begins, with the end of the last."""
    bucket = (sorted_keys >> np.uint64(64 - bits)).astype(np.int32)
    begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    return bucket[begins], np.append(begins, len(bucket))


def _slices(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The bytes of the values from each begin to the next."""
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer((begins * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _gathered(rows: DataFrame, *keys: str) -> DataFrame:
    """The packed rows, those of the same keys one after the other in one partition."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sum of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(keys) else np.empty(0, np.int64)


def _mined(rows: DataFrame, level: int, before, filter_bits: int, support: int, lowered: list[int] | None = None) -> DataFrame:
    """shard, key, n: what shards hold of words, pairs or triples whose parts were frequent in the shard.

    Pairs and triples have the lowered support of their shard, words the support over all shards; null keys count the
    words of the shards.
    """

    def keys_of(batch, texts):
        _, langs, shard = batch.columns
        texts = [(t or "").encode() for t in texts]
        raw, _, starts, ends, follows = _words_of(texts)
        own = np.diff(np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts])))
        salts = np.array([_salt(lang) for lang in langs.to_pylist()], np.uint64)
        words = mixed(span_hashes(raw, starts, ends) ^ np.repeat(salts, own)) & _BITS
        of = np.repeat(np.asarray(shard).astype(np.int64), own)
        if level == 1:
            return words, of
        good = has(before.value, _of_shard(words, of), filter_bits) if level == 2 else np.ones(len(words), bool)
        at = np.flatnonzero(follows & good[1:] & good[:-1])
        pair = _pair_hash(words[at], words[at + 1])
        if level == 2:
            return pair, of[at]
        good = has(before.value, _of_shard(pair, of[at]), filter_bits)
        at, pair = at[good], pair[good]
        j = np.flatnonzero(at[1:] == at[:-1] + 1)
        return _triple_hash(pair[j], words[at[j] + 2]), of[at[j]]

    def pack(shard, keys):
        own, counts = np.unique(np.concatenate(keys), return_counts=True)
        bucket, begins = _in_buckets(own, _BUCKET_BITS)
        short = (own << np.uint64(_BUCKET_BITS)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), shard, np.int32)), _slices(np.ascontiguousarray(short).ravel(), begins * 6), _slices(counts.astype(np.uint32), begins)], ["bucket", "shard", "keys", "counts"])

    def packed(batches):
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for batch, texts in text_groups(batches, limit=_GROUP):
            keys, of = keys_of(batch, texts)
            for shard in np.unique(of):
                held.setdefault(int(shard), []).append(keys[of == shard])
            size += len(keys)
            if size >= _KEYS:
                yield from (pack(*item) for item in held.items())
                held, size = {}, 0
        yield from (pack(*item) for item in held.items())
        give_back()

    def unpacked(bucket, keys):
        keys = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 6)
        long = np.zeros((len(keys), 8), np.uint8)
        long[:, :6] = keys
        return (long.view(">u8").ravel().astype(np.uint64) >> np.uint64(_BUCKET_BITS)) | np.uint64(bucket << (64 - _BUCKET_BITS))

    def counted(batches):
        for bucket, own in groupby(_rows(batches), itemgetter(0)):
            parts: dict[int, tuple[list[bytes], list[bytes]]] = {}
            for _, shard, keys, counts in own:
                kept = parts.setdefault(shard, ([], []))
                kept[0].append(keys)
                kept[1].append(counts)
            sums = {s: _summed(unpacked(bucket, keys), np.frombuffer(b"".join(counts), np.uint32)) for s, (keys, counts) in parts.items()}
            del parts
            if level == 1:
                every, total = _summed(np.concatenate([k for k, _ in sums.values()]), np.concatenate([n for _, n in sums.values()]))
                every = every[total >= support]
            for shard, (key, n) in sums.items():
                enough = np.isin(key, every, assume_unique=True) if level == 1 else n >= lowered[shard]
                keys, counts = pa.array(key[enough].view(np.int64)), n[enough]
                if level == 1:
                    keys, counts = pa.concat_arrays([keys, pa.nulls(1, pa.int64())]), np.append(counts, n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), shard, np.int32)), keys, pa.array(counts)], ["shard", "key", "n"])
        give_back()

    return _gathered(rows.mapInArrow(packed, "bucket int, shard int, keys binary, counts binary"), "bucket").mapInArrow(counted, "shard int, key long, n long")


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of every language in groups of about _GROUP bytes; no more than eight times that is held."""
    held: dict[str, list[bytes]] = {}
    size: Counter[str] = Counter()
    for batch, texts in text_groups(batches, limit=_GROUP):
        for text, lang in zip(texts, batch.column(1).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text.encode())
                size[lang] += len(held[lang][-1])
        for lang in list(held) if sum(size.values()) >= 8 * _GROUP else [k for k in held if size[k] >= _GROUP]:
            del size[lang]
            yield lang, held.pop(lang)
    yield from held.items()


def _counted(rows: DataFrame, candidates, filter_bits: int, support: int) -> DataFrame:
    """lang, words, phrase, f: how often each candidate with the support occurs; with words = 0, all words of the language."""

    def packed(batches):
        for lang, texts in _by_language(batches):
            found = Phrases(texts, _salt(lang), lambda keys: has(candidates.value, keys, filter_bits))
            parts = [(0, np.zeros(1, np.int32), np.array([0, 1]), pa.array([b"\n"]), np.array([found.n]))]
            for k, (words, hashes, counts) in found.found.items():
                order = np.argsort(hashes)
                parts.append((k, *_in_buckets(hashes[order], _PHRASE_BITS), found.lines(words[order]), counts[order]))
            for k, bucket, begins, lines, counts in parts:
                if len(bucket):
                    _, offsets, data = lines.buffers()
                    phrases = pa.Array.from_buffers(pa.binary(), len(bucket), [None, pa.py_buffer(np.frombuffer(offsets, np.int32)[begins]), data])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket)), pa.array(np.full(len(bucket), k, np.int32)), pa.array(bucket), phrases, _slices(counts.astype(np.uint32), begins)], ["lang", "words", "bucket", "phrases", "counts"])
        give_back()

    def summed(batches):
        for (lang, k, _), own in groupby(_rows(batches), itemgetter(0, 1, 2)):
            parts = [row[3:] for row in own]
            data, counts = b"".join(p for p, _ in parts), np.frombuffer(b"".join(c for _, c in parts), np.uint32)
            del parts
            offsets = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1])
            lines = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
            f = np.zeros(len(lines.dictionary), np.int64)
            np.add.at(f, np.asarray(lines.indices), counts)
            good = np.flatnonzero((f >= support) | (k == 0))
            phrases = pa.array([line[:-1].decode() for line in lines.dictionary.take(pa.array(good)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(good), pa.string()), pa.array(np.full(len(good), k, np.int32)), phrases, pa.array(f[good])], ["lang", "words", "phrase", "f"])
        give_back()

    rows = rows.mapInArrow(packed, "lang string, words int, bucket int, phrases binary, counts binary")
    return _gathered(rows, "lang", "words", "bucket").mapInArrow(summed, "lang string, words int, phrase string, f long")


def frequent_phrases(docs: DataFrame, support: int = 10, *, text_col: str = "text", lang_col: str = "lang", shards: int = 2, filter_bits: int = 26) -> DataFrame:
    """lang, words, phrase, f: every phrase of one to three words with the support in its language, and with words = 0 the words of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("lang", "text"), F.lit(shards)).cast("int"))
    singles, path = written_at(_mined(rows, 1, None, filter_bits, support), "shard-words")
    sizes = {r["shard"]: r["n"] for r in singles.filter("key is null").groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    total = sum(sizes.values())
    lowered = [max(1, -(-support * sizes.get(s, 0) // max(1, total))) for s in range(shards)]
    enough = F.col("n") >= F.element_at(F.array(*[F.lit(x) for x in lowered]), F.col("shard") + 1)
    paths, levels = [path], [singles.filter("key is not null").filter(enough)]
    for level in (2, 3):
        before = _filter_of(levels[-1], filter_bits)
        found, path = written_at(_mined(rows, level, before, filter_bits, support, lowered), "shard-phrases")
        before.unpersist()
        paths.append(path)
        levels.append(found)
    candidates = _filter_of(levels[0].unionByName(levels[1]).unionByName(levels[2]).withColumn("shard", F.lit(None)), filter_bits)
    out, _ = written_at(_counted(rows, candidates, filter_bits, support), "phrases")
    candidates.unpersist()
    discard(spark, *paths)
    return out


def collocations(docs: DataFrame, support: int = 10, top: int = 2000, *, inside: int = 50, text_col: str = "text", lang_col: str = "lang", shards: int = 2, filter_bits: int = 26, salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two or three words of each language.

    A phrase is dropped if one longer candidate around it has inside per cent of its occurrences or more. top: rows a
    language. shards: of the mining; the fewer they are, the nearer their support is to the global one, and the fewer
    candidates don't have it. filter_bits: log2 of the bits of the filters that scans get. salts: parts of a
    language that are ranked on their own before their best are ranked together.
    """
    frequent = frequent_phrases(docs, support, text_col=text_col, lang_col=lang_col, shards=shards, filter_bits=filter_bits)
    phrases = frequent.filter("words > 0").select("lang", "phrase", "f")
    found = frequent.filter("words > 1").withColumnRenamed("f", "a")
    cuts = found.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    cuts = cuts.join(phrases.toDF("lang", "first", "l"), ["lang", "first"]).join(phrases.toDF("lang", "rest", "r"), ["lang", "rest"])
    whole = "cast({} as decimal(15, 0))"
    score = F.expr(f"({whole.format('a')} * {whole.format('a')} * 1000000) div ({whole.format('l')} * {whole.format('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = found.filter("words = 3").select("lang", "a", F.explode(F.expr("array_distinct(array(substring_index(phrase, ' ', 2), substring_index(phrase, ' ', -2)))")).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_around"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"_around is null or 100 * _around < {inside} * a"))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top).drop("rank")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    sizes = frequent.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
