"""Removes passages of k words that stood earlier in the corpus, found with one FM-index for each shard.

Windows are dealt to shards by content: the smallest hash of the 4-word grams in a window is its anchor, so equal
windows have equal anchors wherever they stand, and neighbouring windows mostly share theirs. A run of windows with one
anchor is a segment of at most 2 k - 4 words.

1. A map task describes segments by 96 bits of hash and keeps the first of equal ones; the others are repeats as a
   whole. Segments meet by anchor, and again only the first of equal ones remains. So copies, however many, are never
   gathered.
2. Equal windows have their anchor at the same place, with half of their other words on one side of it at least. So of
   the remaining segments only those go on that have the words of a side, anchor included, in common with another of
   their anchor (23 bits of hash a side). Nothing is lost, and chance meetings in one frequent 4-gram, whose share
   grows with the corpus, end here.
3. An anchor with very many different segments is taken apart into single windows, which meet by their own hash.
4. The words of the other segments are fetched and dealt to shards. Each shard builds an FM-index over its segments in
   the order of the corpus, and streams them through it: backward search gives the length of the longest match at
   every word, matches of k words are reported, and the sampled suffix array tells which place is the first.
5. The reported windows are removed from their documents.

Windows are judged on the input. Defined results: a null text has no words; a text with fewer words than k keeps all;
a null id counts as the largest; equal ids go by a checksum of their texts; rows that share id and text are one
document and get the same result; an empty table gives an empty result; texts of any length are read whole; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import give_back, mixed, power, spans_of, text_groups, text_table, window_hashes, word_hashes, written
from brindle.llm.fm_index import FMIndex

_GRAM = 4
_SEGMENT, _REPEAT = 0, 1
_SEGMENTS = "kind int, anchor long, content long, check int, doc long, tie int, start int, n int, sides long"
_NAMES = ["kind", "anchor", "content", "check", "doc", "tie", "start", "n", "sides"]
_TYPES = [np.int32, np.int64, np.int64, np.int32, np.int64, np.int32, np.int32, np.int32, np.int64]
_PLACES = "kind int, anchor long, doc long, tie int, start int, n int"
_SIDE = 24
_LAST = (1 << 63) - 1


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """columns: anchor, content, check, doc, tie, start, n, sides."""
    columns = [np.full(len(columns[0]), kind), *columns]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c.view(np.int64) if c.dtype == np.uint64 else c.astype(t))) for c, t in zip(columns, _TYPES)], _NAMES)


def _split(columns: list[np.ndarray]):
    """Segments of a task: the first of equal ones, and the others as repeats, which are spread by their place."""
    anchor, content, check, doc, tie, start, n, sides = columns
    order = np.lexsort((start, tie, doc, check, content, anchor))
    anchor, content, check, doc, tie, start, n, sides = (c[order] for c in columns)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (check[1:] != check[:-1])])
    group = np.cumsum(new) - 1
    later = (doc != doc[new][group]) | (tie != tie[new][group]) | (start != start[new][group])
    yield _rows(_SEGMENT, *(c[new] for c in (anchor, content, check, doc, tie, start, n, sides)))
    if later.any():
        place = mixed(doc[later].view(np.uint64) * np.uint64(1 << 20) + start[later].astype(np.uint64))
        none = np.zeros(len(place), np.int64)
        yield _rows(_REPEAT, place, none, none, *(c[later] for c in (doc, tie, start, n)), none)


def _check(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """32 bits of a second hash of the words from first on."""
    other = mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(other * power("up", len(other)), dtype=np.uint64)])
    return (mixed((sums[first + size] - sums[first]) * power("down", len(other))[first]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def segments(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, window counts, anchors, content hashes and sides of the segments of words that belong to owners (non-decreasing).

    sides: hashes of the anchor with the words before it, and with those behind it, half a window each; 0 where the
    segment does not reach so far.
    """
    none = np.empty(0, np.int64)
    if len(hashes) < k:
        return none, none, none.view(np.uint64), none.view(np.uint64), none
    grams = window_hashes(hashes, _GRAM)
    starts = np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :])
    lead = np.lib.stride_tricks.sliding_window_view(grams, k - _GRAM + 1).argmin(1)[starts] + starts
    if not len(starts):
        return none, none, none.view(np.uint64), none.view(np.uint64), none
    new = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    n = np.diff(np.append(new, len(starts)))
    first = starts[new]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power("up", len(hashes)), dtype=np.uint64)])
    down = power("down", len(hashes))
    content = mixed((sums[first + n + k - 1] - sums[first]) * down[first] + n.astype(np.uint64))
    at, half = lead[new], (k - _GRAM + 1) // 2
    sides = np.zeros(len(first), np.int64)
    for a, b in ((at - half, at + _GRAM), (at, at + _GRAM + half)):
        inside = (a >= first) & (b <= first + n + k - 1)
        a, b = a[inside], b[inside]
        sides <<= _SIDE
        sides[inside] |= (mixed((sums[b] - sums[a]) * down[a]) >> np.uint64(64 - _SIDE)).astype(np.int64) | 1
    return first, n, grams[lead[new]], content, sides


def _describe(k: int):
    def run(batches):
        for batch, texts in text_groups(batches, limit=3_000_000):
            hashes, at = word_hashes([(t or "").encode() for t in texts])
            doc, tie = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            start, n, anchor, content, sides = segments(hashes, np.repeat(np.arange(len(texts)), np.diff(at)), k)
            if not len(start):
                continue
            row = np.searchsorted(at, start, side="right") - 1
            yield from _split([anchor, content, _check(hashes, start, n + k - 1), doc[row], tie[row], start - at[row], n, sides])
        give_back()

    return run


def _compare(batches):
    """Of segments sorted by anchor, content, check and place: the first of equal ones; the others as repeats. A batch has one kind."""
    last = None  # anchor, content, check, and the place of the content at hand
    for batch in batches:
        kind = np.asarray(batch.column(0))
        if (kind == _REPEAT).any():
            yield batch.filter(pa.array(kind == _REPEAT))
            batch = batch.filter(pa.array(kind == _SEGMENT))
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(1, 9)]
        same = np.all([np.concatenate([[last is not None and c[0] == last[i]], c[1:] == c[:-1]]) for i, c in enumerate(columns[:3])], axis=0)
        new = np.flatnonzero(~same)
        group = np.cumsum(~same)
        heads = [np.concatenate([[last[3 + i] if last else 0], c[new]])[group] for i, c in enumerate(columns[3:6])]
        later = same & np.any([c != h for c, h in zip(columns[3:6], heads)], axis=0)
        if later.any():
            yield _rows(_REPEAT, *(c[later] for c in columns))
        if len(new):
            yield batch.take(pa.array(new))
        last = (*(c[-1] for c in columns[:3]), *(h[-1] for h in heads))


def _share_a_side(anchor: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Which segments have the words on one side of the anchor in common with another segment of it."""
    shared = np.zeros(len(anchor), bool)
    for side in (sides >> _SIDE, sides & ((1 << _SIDE) - 1)):
        order = np.lexsort((side, anchor))
        a, s = anchor[order], side[order]
        same = (a[1:] == a[:-1]) & (s[1:] == s[:-1]) & (s[1:] > 0)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
    return shared


def _pruned(batches, limit: int):
    """Of rows of _compare(): repeats, and the segments that may have a window in common. An anchor with more than limit segments is not pruned, so that no more are held."""
    held, size, open_ = [], 0, None  # the segments of the anchor at hand, and an anchor that is not pruned

    def those_sharing():
        rows = pa.Table.from_batches(held)
        shared = _share_a_side(np.asarray(rows.column("anchor")), np.asarray(rows.column("sides")))
        yield from rows.filter(pa.array(shared)).to_batches()

    for batch in batches:
        if batch.column(0)[0].as_py() == _REPEAT:
            yield batch
            continue
        anchor = np.asarray(batch.column(1))
        if open_ is not None:
            more = int(np.searchsorted(anchor != open_, True)) if anchor[0] == open_ else 0
            if more:
                yield batch.slice(0, more)
                batch, anchor = batch.slice(more), anchor[more:]
            if not len(anchor):
                continue
            open_ = None
        last = int(np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))[-1])
        if last:
            held.append(batch.slice(0, last))
        if held and (last or anchor[0] != held[-1].column(1)[0].as_py()):
            yield from those_sharing()
            held, size = [], 0
        held.append(batch.slice(last))
        size += held[-1].num_rows
        if size > limit:
            yield from held
            held, size, open_ = [], 0, anchor[-1]
    if held:
        yield from those_sharing()


def _meet(limit: int):
    """Places of the rows of _pruned()."""

    def run(batches):
        for batch in _pruned(_compare(batches), limit):
            yield batch.select(["kind", "anchor", "doc", "tie", "start", "n"])

    return run


def _pieces(batch: pa.RecordBatch, texts: list[str | None], k: int):
    """Of rows (doc, tie, text, doc_id, parts): each part with its document and words, if the text is the one that it was cut from."""
    for doc, tie, text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(4).to_pylist()):
        words = (text or "").encode().split()
        for p in parts:
            if (size := p["n"] + k - 1) + p["start"] <= len(words):
                yield p["anchor"], doc, tie, p["start"], words[p["start"] : p["start"] + size]


def _fetch(k: int):
    """The words of a document's segments, by shard."""

    def run(batches):
        for batch, texts in text_groups(batches):
            rows = [(anchor, doc, tie, start, b" ".join(words)) for anchor, doc, tie, start, words in _pieces(batch, texts, k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["shard", "doc", "tie", "start", "words"])
        give_back()

    return run


def _windows(k: int):
    """The windows of a document's segments as segments of their own, each with its hash as its anchor."""

    def run(batches):
        for batch, texts in text_groups(batches):
            rows = list(_pieces(batch, texts, k))
            if not rows:
                continue
            hashes, at = word_hashes([b" ".join(r[4]) for r in rows])
            n = np.diff(at) - k + 1
            of = np.repeat(np.arange(len(rows)), n)
            offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            first = at[:-1][of] + offset
            own = window_hashes(hashes, k)[first]
            doc, tie, start = (np.array([r[i] for r in rows], t)[of] for i, t in ((1, np.int64), (2, np.int32), (3, np.int32)))
            yield from _split([own, own, _check(hashes, first, np.full(len(of), k)), doc, tie, start + offset, np.ones(len(of), np.int32), np.zeros(len(of), np.int64)])
        give_back()

    return run


def earlier_windows(pieces: list[tuple[int, int, int, list[bytes]]], k: int) -> list[tuple[int, int, int, int]]:
    """(doc, tie, first window, number of windows) of the runs of windows that also stand earlier among the pieces (doc, tie, start, words)."""
    pieces = sorted(pieces, key=lambda p: p[:3])
    names: dict[bytes, int] = {}
    lengths = np.fromiter((len(p[3]) for p in pieces), np.int64, len(pieces))
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) + 1
    text = np.zeros(int(lengths.sum()) + len(pieces) + 1, np.int64)
    for b, piece in zip(begin.tolist(), pieces):
        text[b : b + len(piece[3])] = [names.setdefault(w, len(names) + 1) for w in piece[3]]
    n = lengths - k + 1
    piece = np.repeat(np.arange(len(pieces)), n)
    at = begin[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    index = FMIndex(text)
    length, low, high = index.matches(text, at + k - 1, k)
    earlier, found = np.zeros(len(at), bool), np.flatnonzero(length >= k)
    if not len(found):
        return []
    bounds, of = np.unique(np.stack([low[found], high[found]], 1), axis=0, return_inverse=True)
    sizes = bounds[:, 1] - bounds[:, 0]
    starts = np.cumsum(sizes) - sizes
    rows = np.repeat(bounds[:, 0] - starts, sizes) + np.arange(int(sizes.sum()))
    # the text is in the order of the corpus, but a window stands twice where two segments of one document overlap
    spots = index.locate(rows)
    places = np.searchsorted(begin, spots, side="right") - 1
    key = np.array([p[:3] for p in pieces], np.int64)
    doc, tie, start = key[places, 0], key[places, 1], key[places, 2] + spots - begin[places]
    order = np.lexsort((start, tie, doc, np.repeat(np.arange(len(sizes)), sizes)))
    first = order[starts]
    own = key[piece[found]]
    offset = own[:, 2] + at[found] - begin[piece[found]]
    first = first[of.ravel()]
    earlier[found] = (doc[first] != own[:, 0]) | (tie[first] != own[:, 1]) | (start[first] != offset)
    out = []
    for a, b in zip(*spans_of(earlier)):
        cuts = [a, *(np.flatnonzero(piece[a + 1 : b] != piece[a : b - 1]) + a + 1).tolist(), b]
        for x, y in zip(cuts, cuts[1:]):
            own = pieces[piece[x]]
            out.append((own[0], own[1], own[2] + int(at[x] - begin[piece[x]]), int(y - x)))
    return out


def _search(k: int, shard_words: int):
    """Of segments sorted by shard: repeats. Whole shards are taken together up to shard_words words."""

    def run(batches):
        pieces, size, last = [], 0, None

        def found():
            got = earlier_windows(pieces, k) if len(pieces) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc", "tie", "start", "n"])

        for batch in batches:
            for shard, *place, words in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size > shard_words and shard != last:
                    yield found()
                    pieces, size = [], 0
                last = shard
                pieces.append((*place, words.split()))
                size += len(pieces[-1][3])
        yield found()
        give_back()

    return run


def _remove(k: int):
    def run(batches):
        for batch, texts in text_groups(batches):
            n_words, n_removed, removed, kept = [], [], [], []
            for text, parts in zip(texts, batch.column(1).to_pylist()):
                words = (text or "").encode().split()
                gone = np.zeros(len(words), bool)
                if parts:
                    step = np.zeros(len(words) + 1, np.int64)
                    a = np.minimum([p["start"] for p in parts], len(words))
                    b = np.minimum([p["start"] + p["n"] + k - 1 for p in parts], len(words))
                    np.add.at(step, a, 1)
                    np.add.at(step, b, -1)
                    gone = np.cumsum(step)[:-1] > 0
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                removed.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(*spans_of(gone))])
                kept.append((b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if parts else b" ".join(words)).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "removed", "kept"],
            )

    return run


def dedup_substrings(docs: DataFrame, k: int = 20, *, id_col: str = "doc_id", text_col: str = "text", shard_words: int = 200_000, split_at: int = 4_000, prune_at: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_removed, removed (runs of word numbers, ends included), kept (the other words, one space between).

    shard_words: size at which a task closes an index. split_at: different segments that an anchor may have unsplit.
    prune_at: segments of one anchor that a task holds to see which share a side; beyond, all go on and are split.
    """
    texts = text_table(docs, id_col, text_col)
    texts = texts.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), (F.crc32(F.coalesce("text", F.lit(""))) - (1 << 31)).cast("int").alias("tie"), "text", "doc_id")
    place = ["doc", "tie"]

    def met(rows: DataFrame, name: str) -> DataFrame:
        sorted_ = rows.repartition(F.col("anchor")).sortWithinPartitions("anchor", "content", "check", "doc", "tie", "start")
        return written(sorted_.mapInArrow(_meet(prune_at), _PLACES), name)

    def with_parts(segments_: DataFrame) -> DataFrame:
        parts = segments_.groupBy(*place).agg(F.collect_list(F.struct("start", "n", "anchor")).alias("parts"))
        # with all columns of texts, so that the last join finds the same exchange and uses it again
        return texts.join(parts.hint("merge"), place).select("doc", "tie", "text", "doc_id", "parts")

    rows = met(texts.drop("doc_id").mapInArrow(_describe(k), _SEGMENTS), "segments")
    repeats = rows.filter(F.col("kind") == _REPEAT).select(*place, "start", "n")
    several = rows.filter(F.col("kind") == _SEGMENT).select("anchor", *place, "start", "n")
    large = written(several.groupBy("anchor").agg(F.count(F.lit(1)).alias("_of")).filter(F.col("_of") > split_at).select("anchor"), "large-anchors")
    if not large.isEmpty():
        windows = met(with_parts(several.join(large, "anchor", "left_semi")).mapInArrow(_windows(k), _SEGMENTS), "windows")
        repeats = repeats.unionByName(windows.filter(F.col("kind") == _REPEAT).select(*place, "start", "n"))
        several = several.join(large, "anchor", "left_anti")
    pieces = with_parts(several).mapInArrow(_fetch(k), "shard long, doc long, tie int, start int, words binary")
    found = pieces.repartition(F.col("shard")).sortWithinPartitions("shard").mapInArrow(_search(k, shard_words), "doc long, tie int, start int, n int")
    gone = repeats.unionByName(found).groupBy(*place).agg(F.collect_list(F.struct("start", "n")).alias("parts"))
    joined = texts.join(gone.hint("merge"), place, "left").select("text", "parts", "doc_id")
    return joined.mapInArrow(_remove(k), "doc_id long, n_words long, n_removed long, removed array<struct<first:int,last:int>>, kept string")
