"""Jaccard self-join of texts on word n-grams with signature trees, reduced to groups of linked documents.

Three steps, none of which lists the pairs of a group:

1. Documents with equal sets of n-grams are linked to the smallest of them; only that one goes on. Each set is cut into
   buckets by hash range, one more than a linked partner may differ in, so linked sets agree in a whole bucket.
   Documents that share a bucket's fingerprint are joined to the smallest of them; within a task that happens before
   the shuffle, so a common fingerprint is one row for each task.
2. The components of those candidate links are gathered. Sets that share passages chain up, so a component of more than
   one tile is first taken apart: linked sets share an n-gram among the rarest of each, and most sets there have enough
   n-grams of their own to be linked with nothing. What is still large is compared in tiles of bounded size.
3. In a tile, sets are first compared with a few leaders, and what is linked to a leader is one group. Then a signature
   tree holds, for every node, the OR of its sets' bitmaps and their range of sizes. Two trees are walked together; a
   pair of nodes is dropped if the largest overlap it allows is too small, or if all their sets are linked already.
   Pairs that are left are compared exactly, and what their hashes link is confirmed on the words themselves.

Why no link is lost: sets with sizes n and m that are linked differ in at most D = floor((1 - t) (n + m) / (1 + t))
n-grams, thus in D buckets at most. A set shows the fingerprints of its D + 1 largest buckets or more, D being that of
its largest partner, so one of them is also a bucket of the partner; of two partners, the one whose smallest shown
bucket is larger finds that bucket shown by the other too. A set with fewer buckets that aren't empty shows all of them
and its prefix of smallest hashes, of which two such sets share one.

n-grams are counted by 64-bit hashes. Equal sets are found by 124 bits of fingerprint, beyond any chance of an accident.

Defined results: a text with fewer words than n is one n-gram, and without words it is empty and linked with nothing;
a null text is empty; a null id is never linked and has no component; rows that share an id are one document, whatever
their texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import give_back, mixed, text_groups, text_table, window_hashes, word_hashes, written
from brindle.llm.components import components

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Kinds of rows. From _COPY on, a row is (second half of a set's fingerprint, first half, id).
_KEY, _EDGE, _NODE, _SAME, _COPY = 0, 1, 2, 3, 16
_ROWS = "kind long, a long, b long"
_WORDS = 32  # 64-bit words of a bitmap at least; it has two bits or more for each entry of the largest set, as far as
_MAP_BYTES = 32_000_000  # the bitmaps of a tree's sets allow
_FANOUT = 8
_AT_ONCE = 4096  # pairs of nodes that are opened together


def ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text, A-Z lower-cased."""
    hashes, at = word_hashes([(t or "").encode().translate(_LOWER) for t in texts])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        words = hashes[a:b]
        out.append(np.unique(window_hashes(words, min(n, len(words)))) if len(words) else np.empty(0, np.uint64))
    return out


def most_different(n: int, m: int, num: int, den: int) -> int:
    """The largest symmetric difference of linked sets of n and m entries."""
    return (den - num) * (n + m) // (den + num)


def bucket_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Fingerprints of a set: linked sets have one in common.

    Of its buckets a set shows the largest, one more than a linked partner may differ in, and those of equal size.
    """
    n = len(s)
    if not n:
        return np.empty(0, np.uint64)
    largest = n * den // num
    out, need = [], most_different(n, largest, num, den)
    for c in {n.bit_length() - 1, largest.bit_length() - 1}:
        top = (2 << c) - 1
        d = most_different(top, top, num, den)
        m = d + 1 + d // 3
        bucket = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        keys = mixed(np.add.reduceat(mixed(s + np.uint64(1)), starts) + bucket[starts] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c))
        if len(starts) > need:
            sizes = np.diff(np.append(starts, n))
            out.append(keys[sizes >= np.partition(sizes, len(sizes) - 1 - need)[len(sizes) - 1 - need]])
        else:  # too many empty buckets
            out += [keys, mixed(s[: n - -(-num * n // den) + 1] ^ np.uint64(0xA5A5A5A55A5A5A5A))]
    return np.concatenate(out)


def _rows(kind: int | np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    kind = np.full(len(a), kind, np.int64) if isinstance(kind, int) else kind
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(np.ascontiguousarray(b).view(np.int64))], ["kind", "a", "b"])


def set_fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two sums over differently mixed entries, as an integer of 64 bits and one of 60 bits above _COPY."""
    first = mixed(mixed(s + np.uint64(len(s))).sum(keepdims=True))[0]
    second = mixed(mixed(s ^ np.uint64(0x3C6EF372FE94F82B)).sum(keepdims=True))[0]
    return int(first.view(np.int64)), _COPY + (int(second) >> 4)


def _fingerprints(n: int, num: int, den: int):
    """Rows of a map task: set sizes, copies of equal sets, and of the others the keys with the smallest id that has them here and links of the other ids to it."""

    def run(batches):
        for batch, texts in text_groups(batches, limit=2_000_000):
            sets = ngram_sets(texts, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sets), _NODE, np.int64)), batch.column(0), pa.array([len(s) for s in sets], pa.int64())], ["kind", "a", "b"])
            known = sorted(((i, s) for i, s in zip(batch.column(0).to_pylist(), sets) if i is not None and len(s)), key=lambda x: x[0])
            if not known:
                continue
            first: dict[tuple[int, int], int] = {}
            same, distinct = [], []
            for i, s in known:
                if (f := first.setdefault(set_fingerprint(s), i)) != i:
                    same.append((i, f))
                else:
                    distinct.append((i, s))
            if same:
                yield _rows(_SAME, *np.array(same, np.int64).T)
            yield _rows(np.array([k[1] for k in first], np.int64), np.array([k[0] for k in first], np.int64), np.array(list(first.values()), np.int64))
            keys = [bucket_keys(s, num, den) for _, s in distinct]
            ids = np.repeat(np.array([i for i, _ in distinct], np.int64), [len(k) for k in keys])
            flat = np.concatenate(keys)
            order = np.lexsort((ids, flat))
            flat, ids = flat[order], ids[order]
            new = np.concatenate([[True], flat[1:] != flat[:-1]])
            yield _rows(_KEY, flat[new], ids[new])
            lead = ids[new][np.cumsum(new) - 1]
            other = ids != lead
            if other.any():
                yield _rows(_EDGE, *np.unique(np.stack([ids[other], lead[other]], 1), axis=0).T)
        give_back()

    return run


def _stars(batches):
    """Of rows sorted by kind, a, b: the ids of every key and of every copied set joined to the first; other rows as they are."""
    last_kind = last_key = last_first = None
    for batch in batches:
        kind, a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1).fill_null(-1)), np.asarray(batch.column(2))
        keys = (kind == _KEY) | (kind >= _COPY)
        if not keys.all():
            yield batch.filter(pa.array(~keys))
        if keys.any():
            kind, a, b = kind[keys], a[keys], b[keys]
            new = np.concatenate([[kind[0] != last_kind or a[0] != last_key], (a[1:] != a[:-1]) | (kind[1:] != kind[:-1])])
            heads = np.concatenate([[last_first if last_first is not None else b[0]], b[new]])
            first = heads[np.cumsum(new)]
            last_kind, last_key, last_first = kind[-1], a[-1], first[-1]
            for which, out in ((kind == _KEY, _EDGE), (kind >= _COPY, _SAME)):
                other = which & (b != first)
                if other.any():
                    yield _rows(out, *np.unique(np.stack([b[other], first[other]], 1), axis=0).T)


# ---------------------------------------------------------------- signature trees


class SignatureTree:
    """A tree over sets sorted by size. Each node: OR of bitmaps, smallest and largest size, most entries lost to shared bits."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray):
        """labels: of each set, the group that it is known to belong to."""
        sizes = np.array([len(s) for s in sets], np.int64)
        wanted = 1 << int(2 * sizes.max(initial=1) // 64).bit_length()
        self.words = max(_WORDS, min(wanted, _MAP_BYTES // (8 * max(1, len(sets)))))
        maps = np.zeros((len(sets), self.words), np.uint64)
        for i, s in enumerate(sets):
            bit = (s >> np.uint64(7)) % np.uint64(self.words * 64)
            np.bitwise_or.at(maps[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        lost = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, lost, labels, labels)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, lost, first, last = self.levels[-1]
            at = np.arange(0, len(low), _FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))

    def allowed(self, level: int, p: np.ndarray, q: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether sets below the nodes p and q may overlap as far as a link needs, and aren't all in one group."""
        maps, low, high, lost, first, last = self.levels[level]
        out = np.zeros(len(p), bool)
        step = max(64, (1 << 20) // self.words)  # pairs whose maps are held together
        for i in range(0, len(p), step):
            a, b = p[i : i + step], q[i : i + step]
            shared = np.bitwise_count(maps[a] & maps[b]).sum(1, dtype=np.int64) + np.minimum(lost[a], lost[b])
            most = np.minimum(shared, np.minimum(high[a], high[b]))
            out[i : i + step] = (most * (den + num) >= num * (low[a] + low[b])) & (high[a] * den >= num * low[b]) & (high[b] * den >= num * low[a])
            out[i : i + step] &= (first[a] != last[a]) | (first[b] != last[b]) | (first[a] != first[b])
        return out

    def pairs(self, num: int, den: int):
        """Pairs of different sets that the traversal can't rule out, in arrays; depth first, so that few are held."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, p, q = stack.pop()
            keep = self.allowed(level, p, q, num, den)
            p, q = p[keep], q[keep]
            if level == 0:
                apart = p < q
                yield p[apart], q[apart]
                continue
            if not len(p):
                continue
            n = len(self.levels[level - 1][1])
            a = np.repeat(p * _FANOUT, _FANOUT * _FANOUT) + np.tile(np.repeat(np.arange(_FANOUT), _FANOUT), len(p))
            b = np.repeat(q * _FANOUT, _FANOUT * _FANOUT) + np.tile(np.arange(_FANOUT), len(p) * _FANOUT)
            real = (a < n) & (b < n) & (a <= b)
            a, b = a[real], b[real]
            for i in range(0, len(a), _AT_ONCE):
                stack.append((level - 1, a[i : i + _AT_ONCE], b[i : i + _AT_ONCE]))


def word_grams(text: str, n: int) -> frozenset[bytes]:
    """The n-grams themselves."""
    words = text.encode().translate(_LOWER).split()
    return frozenset(b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


class _Groups:
    """Sets and the groups that their links have made so far. Links are confirmed on words."""

    def __init__(self, texts: list[str], sets: list[np.ndarray], n: int, num: int, den: int):
        self.texts, self.sets, self.n, self.num, self.den = texts, sets, n, num, den
        self.parent = np.arange(len(sets))
        self.grams = lru_cache(maxsize=64)(lambda i: word_grams(texts[i], n))

    def roots(self) -> np.ndarray:
        while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
            self.parent = up
        return self.parent

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            x = int(self.parent[x])
        return x

    def linked(self, i: int, j: int) -> bool:
        both = len(self.sets[i]) + len(self.sets[j])
        shared = both - len(np.union1d(self.sets[i], self.sets[j])) if both < 64 else int(np.isin(self.sets[i], self.sets[j], assume_unique=True).sum())
        return self.den * shared >= self.num * (both - shared) and self.confirmed(i, j)

    def confirmed(self, i: int, j: int) -> bool:
        a, b = self.grams(i), self.grams(j)
        shared = len(a & b)
        return self.den * shared >= self.num * (len(a) + len(b) - shared)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)

    def lead(self, rounds: int = 32) -> None:
        """Compares whole tiles with one set after the other, as long as each takes a good part of what is left."""
        sizes = np.array([len(s) for s in self.sets], np.int64)
        left = np.arange(len(sizes))
        for _ in range(rounds):
            if len(left) < 3:
                return
            leader, rest = int(left[0]), left[1:]
            fits = rest[(sizes[rest] * self.num <= sizes[leader] * self.den) & (sizes[leader] * self.num <= sizes[rest] * self.den)]
            taken = np.zeros(len(fits), bool)
            for i in range(0, len(fits), 4096):
                part = fits[i : i + 4096]
                flat, own = np.concatenate([self.sets[j] for j in part]), self.sets[leader]
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                shared = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[part])[:-1]]), dtype=np.int64)
                close = self.den * shared >= self.num * (sizes[part] + sizes[leader] - shared)
                taken[i : i + 4096] = [bool(c) and self.confirmed(leader, int(j)) for c, j in zip(close, part)]
            self.parent[fits[taken]] = leader
            gained = int(taken.sum())
            left = np.setdiff1d(rest, fits[taken], assume_unique=True)
            if gained * 8 < len(left):
                return


def linked_groups(ids: list[int], texts: list[str], n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(id, smallest id of its group) for the ids that are linked with a smaller one."""
    rows = [(i, s, t) for i, s, t in zip(ids, ngram_sets(texts, n), texts) if len(s)]
    first: dict[bytes, int] = {}
    links, distinct = [], []
    for i, s, t in rows:
        if (same := first.setdefault(s.tobytes(), i)) != i:
            links.append((i, same))
        else:
            distinct.append((len(s), i, s, t))
    distinct.sort(key=lambda x: x[:2])
    own, sets = [x[1] for x in distinct], [x[2] for x in distinct]
    if len(own) > 1:
        groups = _Groups([x[3] for x in distinct], sets, n, num, den)
        groups.lead()
        order = np.lexsort((np.arange(len(own)), groups.roots()))  # groups stand together, so that their nodes are dropped early
        for p, q in SignatureTree([sets[i] for i in order], groups.roots()[order].copy()).pairs(num, den):
            p, q = order[p], order[q]
            roots = groups.roots()
            apart = roots[p] != roots[q]
            for i, j in zip(p[apart].tolist(), q[apart].tolist()):
                if groups.root(i) != groups.root(j) and groups.linked(i, j):
                    groups.join(i, j)
        links += [(own[i], own[r]) for i, r in enumerate(groups.roots().tolist()) if own[i] != own[r]]
    return links


def _tiles(n: int, num: int, den: int):
    """Of rows sorted by tile: the links of each tile."""

    def finish(rows):
        return linked_groups([i for i, _ in rows], [t or "" for _, t in rows], n, num, den)

    def run(batches):
        tile, rows, out = None, [], []
        for batch in batches:
            for t, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if t != tile:
                    if len(rows) > 1:
                        out += finish(rows)
                    tile, rows = t, []
                rows.append((i, text))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
                out = []
        if len(rows) > 1:
            out += finish(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
        give_back()

    return run


_GRAMS = "root long, doc_id long, tie long, n long, gram long"
_COUNTED = f"{_GRAMS}, count long"
_MANY = 1024  # n-grams that are more frequent count as equally frequent, so that a task holds so many rows of one


def _grams(n: int):
    """The n-grams of rows (root, doc_id, tie, text)."""

    def run(batches):
        for batch, texts in text_groups(batches):
            sets = ngram_sets(texts, n)
            sizes = np.array([len(s) for s in sets], np.int64)
            own = [np.repeat(np.asarray(batch.column(i)), sizes) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, np.repeat(sizes, sizes), np.concatenate(sets).view(np.int64))], ["root", "doc_id", "tie", "n", "gram"])
        give_back()

    return run


def _shared(batches):
    """Of rows sorted by their last column, n-gram: those whose n-gram stands in several, with their number, _MANY at most."""
    names = [*(x.split()[0] for x in _GRAMS.split(", ")), "count"]
    held = None  # the first rows of the n-gram at hand, _MANY at most; more of it may follow
    for batch in batches:
        rows = np.stack([np.asarray(c) for c in batch.columns], 1)
        told = _MANY if held is not None and len(held) == _MANY else 0  # of rows that went on before
        rows = rows if held is None else np.concatenate([held, rows])
        if not len(rows):
            continue
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, -1] != rows[:-1, -1]]))
        counts = np.diff(np.append(starts, len(rows)))
        # the last n-gram waits for the next batch, unless it is frequent already: then its rows go on at once
        held = rows[starts[-1] :][:_MANY]
        whole = len(rows) if counts[-1] >= _MANY else starts[-1]
        each = np.repeat(np.minimum(counts, _MANY), counts)
        goes = each[:whole] > 1
        goes[:told] = False
        if goes.any():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*rows[:whole][goes].T.copy(), each[:whole][goes])], names)
    if held is not None and 1 < len(held) < _MANY:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*held.T.copy(), np.full(len(held), len(held)))], names)


def _rarest(large: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node, root: smaller candidate components of the rows (root, doc_id, text); a row in none is linked with nothing.

    n-grams are ordered by how many of these rows hold them. Of linked sets with this order, each has one of the other
    among its first, as many as may be missing and one more. An n-gram of a single row is in no other set.
    """
    rows = large.select("root", "doc_id", F.xxhash64("text").alias("tie"), "text")
    counted = rows.mapInArrow(_grams(n), _GRAMS).repartition(F.col("gram")).sortWithinPartitions("gram").mapInArrow(_shared, _COUNTED)
    sets = counted.groupBy("root", "doc_id", "tie", "n").agg(F.array_sort(F.collect_list(F.struct("count", "gram"))).alias("_shared"))
    first = (F.col("n") - F.ceil(F.col("n") * num / den) + 1) - (F.col("n") - F.size("_shared"))  # n-grams of one row alone come before
    sets = sets.withColumn("_first", first.cast("int")).filter("_first > 0")
    keys = sets.select("root", "doc_id", F.explode(F.slice("_shared", F.lit(1), F.col("_first"))).alias("_g"))
    keys = keys.select(F.lit(_KEY).cast("long").alias("kind"), F.xxhash64("root", "_g.gram").alias("a"), F.col("doc_id").alias("b"))
    stars = keys.repartition(F.col("a")).sortWithinPartitions("kind", "a", "b").mapInArrow(_stars, _ROWS)
    found = components(stars.select("a", "b"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def ngram_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, *, id_col: str = "doc_id", text_col: str = "text", tile_words: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links of Jaccard similarity num / den or more reach.

    tile_words: n-grams of half a tile at most, about; a candidate component with more is compared in pairs of parts.
    """
    texts = text_table(docs, id_col, text_col)
    rows = texts.mapInArrow(_fingerprints(n, num, den), _ROWS)
    # keys meet by their value; sizes and links only pass through, so they are dealt evenly, with or without an id
    dealt = F.when((F.col("kind") == _KEY) | (F.col("kind") >= _COPY), F.col("a")).otherwise(F.xxhash64("a", "b", F.spark_partition_id()))
    rows = written(rows.repartition(dealt).sortWithinPartitions("kind", "a", "b").mapInArrow(_stars, _ROWS), "links")
    nodes = rows.filter(F.col("kind") == _NODE).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    same = rows.filter(F.col("kind") == _SAME).select("a", "b")
    candidates = components(rows.filter(F.col("kind") == _EDGE).select("a", "b"))
    members = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("doc_id"), "root")
    held = nodes.groupBy("doc_id").agg(F.sum("n_shingles").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    copies = same.select(F.col("a").alias("doc_id"), F.lit(True).alias("_copy")).distinct()
    # an id with several rows may be a copy by one of them only, so it stays
    members = members.join(held.hint("merge"), "doc_id").join(copies.hint("merge"), "doc_id", "left").filter("_rows > 1 or _copy is null")
    members = written(members.select("doc_id", "root", "_n"), "members")

    def sized(members: DataFrame) -> DataFrame:
        sizes = members.groupBy("root").agg((F.floor(F.sum("_n") / tile_words) + 1).cast("int").alias("_parts"), F.count(F.lit(1)).alias("_of"))
        return written(sizes.filter("_of > 1").drop("_of"), "sizes")

    gathered = texts.join(members.join(sized(members).hint("merge"), "root").hint("merge"), "doc_id")  # both grow with the corpus and are never broadcast
    gathered = written(gathered.select("root", "_parts", "doc_id", "text"), "gathered")
    large = gathered.filter("_parts > 1").select("root", "doc_id", "text")
    if not large.isEmpty():
        finer = _rarest(large, n, num, den).select(F.col("node").alias("doc_id"), "root")
        finer = written(members.drop("root").join(finer.hint("merge"), "doc_id"), "members")
        finer = finer.join(sized(finer).hint("merge"), "root").select("doc_id", "root", "_parts")
        finer = large.drop("root").join(finer.hint("merge"), "doc_id").select("root", "_parts", "doc_id", "text")
        gathered = gathered.filter("_parts = 1").unionByName(finer)
    own = F.pmod(F.xxhash64("doc_id"), F.col("_parts").cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: F.concat_ws(":", F.col("root"), F.least(own, j), F.greatest(own, j)))
    gathered = gathered.select(F.explode(pairs).alias("tile"), "doc_id", "text")
    links = gathered.repartition(F.col("tile")).sortWithinPartitions("tile", "doc_id").mapInArrow(_tiles(n, num, den), "a long, b long")
    groups = components(links.unionByName(same)).select(F.col("node").alias("doc_id"), "root")
    return nodes.join(groups, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
