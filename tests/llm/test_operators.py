import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import bpe, chunks, decontaminate, ngram_join, neighbours, outliers, pii, shard, substring_dedup, tokenfile

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None, extra=False):
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 5 else None, len(t) if t is not None else None) for k, (i, t) in enumerate(zip(ids, texts))]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({"kept": F.lit(1), "start": F.lit("x"), "n_words": F.lit(7), "chunk": F.lit(2)}) if extra else df.repartition(3)


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def sample(seed=0, n=40):
    rng = random.Random(seed)
    passage = words(rng, 60)
    base = [words(rng, rng.choice([0, 3, 15, 30, 90, 400])) for _ in range(n)]
    base[3] = base[2]
    base[5] = base[4][: len(base[4]) // 2] + " " + passage
    base[6] = passage + " " + words(rng, 30)
    base[8] = " ".join(["same"] * 70)
    near = words(rng, 300).split()
    for k in (10, 11, 12, 13):
        copy = list(near)
        for _ in range(4):
            copy[rng.randrange(300)] = "edited"
        base[k] = " ".join(copy)
    base[14] = None
    base[15] = ""
    base[16] = "a\n\nb\tc  d"
    return base


EDGE = [None, "", " ", "one", "\n\n", "é" * 10, "x" * 3000]


@pytest.fixture(params=["mixed", "empty", "edge"])
def docs(request, spark):
    if request.param == "empty":
        return table(spark, [], [])
    if request.param == "edge":
        return table(spark, EDGE + ["twin text here"] * 2, [None, 1, 2, 3, 4, 5, 6, 7, 7], extra=True)
    return table(spark, sample(), extra=True)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0))


# ---- 5: substrings


def brute_substrings(rows, k):
    seen, out = {}, {}
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    occ = defaultdict(list)
    for i, w in texts:
        for s in range(len(w) - k + 1):
            occ[tuple(w[s : s + k])].append((i, s))
    for i, w in texts:
        gone = set()
        for s in range(len(w) - k + 1):
            if min(occ[tuple(w[s : s + k])]) < (i, s):
                gone |= set(range(s, s + k))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_substrings_match_brute_force(spark, seed):
    df = table(spark, sample(seed), extra=True)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup_substrings(df, 20, shard_words=500).collect()}
    assert got == brute_substrings(rows_of(df), 20)


def test_split_anchors_give_the_same(spark):
    df = table(spark, sample(3))
    a = {r["doc_id"]: r["kept"] for r in substring_dedup.dedup_substrings(df, 20, split_at=1, shard_words=100).collect()}
    assert a == {i: v[2] for i, v in brute_substrings(rows_of(df), 20).items()}


def test_split_anchors_gather_no_words(spark, monkeypatch):
    def search(k, shard_words):
        def refuse(batches):
            for batch in batches:
                if batch.num_rows:
                    raise AssertionError("words of a split anchor were fetched")
            yield from ()

        return refuse

    rng = random.Random(9)
    passage = words(rng, 60, 10_000)
    df = table(spark, [f"{words(rng, 25, 10_000)} {passage} {words(rng, 25, 10_000)}" for _ in range(60)])
    monkeypatch.setattr(substring_dedup, "_search", search)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup_substrings(df, 20, split_at=1).collect()}
    assert got == brute_substrings(rows_of(df), 20)


def test_frequent_grams_gather_no_words(spark, monkeypatch):
    def search(k, shard_words):
        def refuse(batches):
            for batch in batches:
                if batch.num_rows:
                    raise AssertionError("words were fetched of segments that have only a 4-gram in common")
            yield from ()

        return refuse

    rng = random.Random(13)
    frequent = [words(rng, 4, 50) for _ in range(20)]
    df = table(spark, [" ".join(f"{rng.choice(frequent)} {words(rng, 6, 100_000)}" for _ in range(30)) for _ in range(60)])
    monkeypatch.setattr(substring_dedup, "_search", search)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup_substrings(df, 20).collect()}
    assert got == brute_substrings(rows_of(df), 20)


@pytest.mark.parametrize("prune_at", [1, 3])
def test_unpruned_anchors_give_the_same(spark, prune_at):
    df = table(spark, sample(4))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup_substrings(df, 20, split_at=2, prune_at=prune_at).collect()}
    assert got == brute_substrings(rows_of(df), 20)


@pytest.mark.parametrize("split_at", [1, 4_000])
def test_rows_of_one_id_are_told_apart(spark, split_at):
    rng = random.Random(12)
    shared, other = words(rng, 60, 10_000), words(rng, 60, 10_000)
    texts = [shared, shared, other, shared + " end", shared + " end", other + " tail"]
    df = table(spark, texts, [1, 2, 2, None, None, None])
    got = sorted((r["doc_id"] or 9, r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(df, 20, split_at=split_at).collect())
    assert got == [(1, 60, 0), (2, 60, 0), (2, 60, 60), (9, 61, 60), (9, 61, 60), (9, 61, 60)]


def test_matching_statistics():
    from brindle.llm.fm_index import FMIndex

    rng = np.random.default_rng(4)
    text = np.concatenate([[0], rng.integers(1, 4, 60), [0], rng.integers(1, 4, 50), [0]])
    index = FMIndex(text, sample=4)
    at = np.flatnonzero(text)
    length, low, high = index.matches(text, at, 9)
    spots = lambda a, b: sorted(index.locate(np.arange(a, b)).tolist())
    for q, n, a, b in zip(at.tolist(), length.tolist(), low.tolist(), high.tolist()):
        stands = lambda m: [i for i in range(len(text) - m + 1) if (text[i : i + m] == text[q - m + 1 : q + 1]).all()]
        fits = [m for m in range(1, 10) if q - m + 1 >= 0 and (text[q - m + 1 : q + 1] > 0).all() and len(stands(m)) > 1]
        assert n == max(fits, default=0)
        assert not n or spots(a, b) == stands(n)


def test_substrings_edge_cases(docs):
    got = substring_dedup.dedup_substrings(docs, 20).collect()
    assert len(got) == docs.count()


# ---- 7: n-gram groups


def brute_groups(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root[a], root[b]
                    root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_groups_match_brute_force(spark, n, num):
    rng = random.Random(n)
    texts = sample(n)
    for base in (7, 25, 120):  # chains of edits around the threshold
        w = words(rng, base).split()
        for _ in range(6):
            w = list(w)
            w[rng.randrange(len(w))] = f"n{rng.random()}"
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    df = table(spark, texts, extra=True)
    for tile in (1_000_000, 200):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_groups(df, n, num, 100, tile_words=tile).collect()}
        assert got == brute_groups(rows_of(df), n, num, 100)


def test_every_linked_pair_shares_a_bucket():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64) * np.uint64(3))
        keep = rng.random(len(a)) > rng.uniform(0, 0.16)
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 1 << 62, int(rng.integers(0, len(a) * 0.1 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            assert len(np.intersect1d(ngram_join.bucket_keys(a, 85, 100), ngram_join.bucket_keys(b, 85, 100)))


def test_groups_edge_cases(docs):
    got = ngram_join.ngram_groups(docs, 4, 85, 100).collect()
    assert len(got) == docs.count()
    assert all(r["component_id"] == r["doc_id"] for r in got if r["n_shingles"] == 0 or r["doc_id"] is None)


# ---- 3: line chunks


def test_a_chain_of_shared_passages_is_taken_apart_before_it_is_gathered(spark, monkeypatch):
    rng = random.Random(9)
    parts = [words(rng, 40, 10**6) for _ in range(121)]
    chain = [f"{parts[i]} {words(rng, 20, 10**6)} {parts[i + 1]}" for i in range(120)]  # each shares a passage with the next, none is near another
    near = words(rng, 300, 10**6).split()
    texts = chain + [" ".join([*near[:k], "other", *near[k:]]) + " " + parts[0] for k in (10, 100, 200)] + ["one two three", "one two four"]
    seen, inner = spark.sparkContext.accumulator(0), ngram_join._tiles

    def counted(*a):
        def told(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return lambda batches, run=inner(*a): run(told(batches))

    monkeypatch.setattr(ngram_join, "_tiles", counted)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_groups(table(spark, texts), 5, 80, 100, tile_words=1000).collect()}
    assert got == {i: 120 if 120 <= i < 123 else i for i in range(len(texts))}
    assert seen.value <= len(texts)  # before: each of the chain's texts in every pair of parts


def test_ngrams_of_several_rows_are_counted_over_batches(monkeypatch):
    monkeypatch.setattr(ngram_join, "_MANY", 3)
    grams = [1, 2, 2, 3, 3, 3, 3, 3, 4, 5, 5, 5]
    rows = [[7, i, 0, 9, g] for i, g in enumerate(grams)]
    for size in (1, 2, 5, 12):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], ["root", "doc_id", "tie", "n", "gram"]) for i in range(0, len(rows), size)]
        got = sorted((r["doc_id"], r["count"]) for b in ngram_join._shared(batches) for r in b.to_pylist())
        assert got == [(i, min(3, grams.count(g))) for i, g in enumerate(grams) if grams.count(g) > 1]


def test_chunks(spark):
    rng = random.Random(4)
    lines = [words(rng, 8) for _ in range(30)]
    texts = ["\n".join(lines), "new first line\n" + "\n".join(lines), "\n".join([words(rng, 8) for _ in range(10)]), None, ""]
    got = {r["doc_id"]: r for r in chunks.dedup_chunks(table(spark, texts, extra=True), carry=["lang"]).collect()}
    assert got[0]["n_removed"] == 0 and got[0]["text"] == texts[0]
    assert got[1]["n_removed"] >= 20 and got[1]["text"].startswith("new first line")
    assert got[2]["text"] == texts[2] and got[3]["text"] is None and got[3]["n_lines"] == 0 and got[4]["text"] == ""


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6])
def test_short_shared_passages_go_whatever_is_around_them(spark, n):
    rng = random.Random(n)
    passage = [words(rng, 12, 10_000) for _ in range(n)]
    around = [([words(rng, 8, 10_000) for _ in range(rng.randrange(4))], [words(rng, 8, 10_000) for _ in range(rng.randrange(4))]) for _ in range(40)]
    texts = ["\n".join(before + passage + after) for before, after in around]
    got = {r["doc_id"]: r for r in chunks.dedup_chunks(table(spark, texts)).collect()}
    assert got[0]["text"] == texts[0]
    assert all(got[i]["n_removed"] == n and got[i]["text"] == "\n".join(before + after) for i, (before, after) in enumerate(around) if i)


def test_pairs_leave_each_line_at_its_first_place(spark):
    rng = random.Random(5)
    lines = [words(rng, 8) for _ in range(12)]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(1, 9))) for _ in range(60)]
    rows = [t.split("\n") for t in texts]
    first = {}
    for i, r in enumerate(rows):
        for s in range(len(r) - 1):
            first.setdefault((r[s], r[s + 1]), (i, s))
    gone = [{s + j for s in range(len(r) - 1) if first[r[s], r[s + 1]] < (i, s) for j in (0, 1)} for i, r in enumerate(rows)]
    got = {r["doc_id"]: r["text"] for r in chunks.dedup_chunks(table(spark, texts), every=1).collect()}
    assert got == {i: "\n".join(x for s, x in enumerate(r) if s not in gone[i]) for i, r in enumerate(rows)}
    assert {x for t in got.values() for x in t.split("\n")} >= {x for r in rows for x in r}


def test_chunks_edge_cases(docs):
    assert chunks.dedup_chunks(docs).count() == docs.count()


# ---- 6: decontamination


def test_decontamination(spark):
    item = " ".join(f"q{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item), (2, "Short Item"), (3, None), (4, "!!")], "item_id long, text string")
    docs = table(spark, ["before, " + item.upper().replace(" ", ", ") + " after", "a short-item here", "clean text", None, ""], extra=True)
    for max_chars in (10**6, 10):
        got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, max_chars=max_chars, carry=["text"]).collect()}
        assert got[0]["n_hit"] == 15 and got[0]["item_ids"] == ["1"]
        s = got[0]["spans"][0]
        assert got[0]["text"][s["start"] : s["end"]].startswith("Q0") and got[0]["text"][s["start"] : s["end"]].endswith("Q14")
        assert got[1]["item_ids"] == ["2"] and got[1]["n_hit"] == 2 and got[2]["n_hit"] == 0 and got[3]["n_words"] == 0


def test_decontamination_edge_cases(spark, docs):
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).filter("n_hit > 0").count() == 0


# ---- 8 and 9: tokens


def fuzz(seed, n=300):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "a", "The", "É", "é", "́", "12", "<|endoftext|>", "'s", "'", "　", "\x1c", "!!", "Σ", "İ", "\xa0", "ending", "x.", "日本"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, texts = Tokenizer.from_file(path), [*fuzz(1), "x" * 5000, "ab " * 100]
    df = bpe.decode_ids(bpe.encode_texts(table(spark, texts, extra=True), path), path)
    for r in df.collect():
        want = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want and r["text"] == lib.decode(want, skip_special_tokens=False)


def test_bpe_edge_cases(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = bpe.decode_ids(bpe.encode_texts(docs, path), path)
    want = sorted((t or "") for _, t in rows_of(docs))
    assert sorted(r["text"] for r in got.collect()) == want


def test_new_words_are_encoded_together(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, b, calls = Tokenizer.from_file(path), bpe.RankBPE(path, remember=100), []
    ranked = b._ranked
    monkeypatch.setattr(b, "_ranked", lambda x, y: calls.append(len(x)) or ranked(x, y))
    rng = random.Random(5)
    letters = "etaoinshrdlucmfwygpbvkxqzjETAé"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) + rng.choice(["", "", ",", ".", "$$", "'s", "9"]) for _ in range(400)) for _ in range(10)]
    texts += [None, "", "y" * 70 + " " + "z" * 1100, *fuzz(7, 50)]
    for _ in range(2):  # the memory is too small for them, so they are encoded again
        got = b.encode_all(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert max(map(len, (b.first, b.later, b.words))) <= 100 and not [w for w in b.words if len(w) > 64]
    assert len(calls) < 1000  # of about 4,000 different words, each with several merges


def test_long_words_use_the_heap_alike():
    b = bpe.RankBPE(public_tokenizers.path("byte_bpe_50k.json"))
    for w in ("the" * 120, "abcdefgh" * 40, "é" * 150):
        assert b.word(w.encode()) == b._long(w.encode())


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, texts = Tokenizer.from_file(path), fuzz(2, 400)
    tokenfile.write_tokens(table(spark, texts, extra=True), str(tmp_path / "t"), path, max_docs=50)
    start = 0
    for r in tokenfile.read_tokens(spark, str(tmp_path / "t")).orderBy("doc_id").collect():
        want = [*lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want and r["start"] == start and r["n_tokens"] == len(want)
        start += len(want)


def test_pieces_are_encoded_without_offsets():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, encoder = Tokenizer.from_file(path), tokenfile.CachedEncoder(path, remember=50)

    class Fast:
        calls = 0

        def encode_batch_fast(self, texts, add_special_tokens):
            Fast.calls += 1
            return lib.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    encoder.tokenizer = Fast()
    rng = random.Random(6)
    run = lambda: "".join(rng.choice("etaoinshrdluETAOéÉß") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(run() + rng.choice(["", "", "", ",", ".", "!!", ".,", "'s", "\nof", "7", "\u0301"]) for _ in range(300)) for _ in range(8)]
    texts += [None, "", "  two  spaces ", "the, The. THE! the", "<|endoftext|> <|ENDOFTEXT|>", *fuzz(8, 60)]
    for some in (texts, texts[:3], texts):  # more pieces than it remembers
        got = encoder.encode(some)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [lib.encode(t or "", add_special_tokens=False).ids for t in some]
    before = Fast.calls
    encoder.encode([" ".join("q" + run() + rng.choice(["", ",", "."]) for _ in range(500))])
    assert Fast.calls == before + 1  # new letter runs share a call


def test_token_files_edge_cases(spark, tmp_path, docs):
    tokenfile.write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"))
    assert tokenfile.read_tokens(spark, str(tmp_path / "t")).count() == docs.count()


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n in (1, 2, 77, 2000):
        for top in (0, 1, 50, 10**6):
            v = np.sort(rng.integers(0, top + 1, n))
            assert (tokenfile.EliasFano.of(v).get(np.arange(n)) == v).all()


# ---- 10: shards


def test_shards(spark):
    rng = random.Random(5)
    df = table(spark, [words(rng, rng.randrange(5)) for _ in range(503)], extra=True)
    for per in (10_000, 20):
        got = shard.interleave(df, 24, per_range=per).collect()
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r)
        assert len(got) == 503 and set(by) == set(range(24))
        assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
        for source in {r["source"] for r in got}:
            share = [sum(r["source"] == source for r in rs) for rs in by.values()]
            assert max(share) - min(share) <= 2
    assert sorted(map(tuple, shard.interleave(df, 24, per_range=20).collect()), key=str) == sorted(map(tuple, shard.interleave(df, 24).collect()), key=str)


def test_shards_edge_cases(docs):
    assert shard.interleave(docs, 24).count() == docs.count()


# ---- 2: rules


def test_counts_match_brute_force():
    texts = [t for t in sample(6)] + EDGE + ["a b c d e a b c d e", "x#*$ | y\nx#*$ | y\n\n\n"]
    got = outliers.text_counts(texts)
    for i, t in enumerate(texts):
        w, grams, seen, dup = WORD.findall(t or ""), defaultdict(list), set(), 0
        for j in range(len(w) - 4):
            grams[tuple(w[j : j + 5])].append(j)
        covered = {p for g in grams.values() if len(g) > 1 for j in g for p in range(j, j + 5)}
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered))
        assert tuple(got[c][i] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_outliers_are_rejected(spark):
    rng = random.Random(7)
    good = [words(rng, rng.randrange(40, 300), 5000) for _ in range(200)]
    bad = [" ".join(f"w{rng.randrange(5000)}***" for _ in range(80)) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good + bad)]
    got = {r["doc_id"]: r["kept"] for r in outliers.quality_rules(spark.createDataFrame(rows, DOC)).collect()}
    assert all(got[i] for i in range(200)) and not any(got[i] for i in range(200, 212))


def test_rules_edge_cases(docs):
    got = outliers.quality_rules(docs).collect()
    assert len(got) == docs.count() and all(not r["kept"] for r in got if r["n_words"] < 10)


def test_chi_square():
    assert outliers.chi_square_below(5.991, 2) == pytest.approx(0.95, abs=1e-3) and outliers.chi_square_quantile(0.95, 5) == pytest.approx(11.07, abs=0.01)


# ---- 1: neighbours


def test_neighbours(spark):
    rng = random.Random(8)
    texts = [words(rng, 60) if i % 2 else " ".join("***" for _ in range(40)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(999, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = neighbours.classify_quality(table(spark, texts, extra=True), labels, width=256, rank=8).collect()
    assert len(got) == 200 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["held_out"]) and any(r["held_out"] for r in got)


def test_neighbours_edge_cases(spark, docs):
    got = neighbours.classify_quality(docs, spark.createDataFrame([], "doc_id long, quality int"), width=64, rank=4).collect()
    assert len(got) == docs.count() and all(r["score"] == 0.5 for r in got)


# ---- 4: personal data


def naive_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_patterns_match_plain_expressions():
    rng = random.Random(9)
    bits = ["a", "@", ".", "1", "22", "4111111111111111", " ", "-", "+1", "(", ")", "b.c", "@d", "256", "%", "é", "+"]
    for _ in range(5000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 16)))
        assert pii.pattern_spans(t) == naive_spans(t)


def test_gradients():
    m = pii.BiLstmCrf(3, 4)
    m.p, m.ban = {k: v.astype(np.float64) for k, v in m.p.items()}, m.ban.astype(np.float64)
    x, y = pii.labelled_windows([], 2, 3)
    _, g = m.gradients(x, y)
    for k in ("O", "D", "T", "Uf", "Vb", "Wb", "cf"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, e = m.p[k][at], 1e-4
        m.p[k][at] = old + e
        a = m.gradients(x, y)[0]
        m.p[k][at] = old - e
        b = m.gradients(x, y)[0]
        m.p[k][at] = old
        assert (a - b) / (2 * e) == pytest.approx(g[k][at], rel=2e-2, abs=1e-5)


def test_paths_match_enumeration():
    m, rng = pii.BiLstmCrf(3, 4), np.random.default_rng(5)
    m.p["T"] = rng.standard_normal(m.p["T"].shape).astype(np.float32)
    e = rng.standard_normal((4, pii.TAGS, 6)).astype(np.float32) * 2
    ok, inside = pii.allowed_steps(), 1 + len(pii.KINDS)
    paths = [p for p in itertools.product(range(pii.TAGS), repeat=4) if p[0] < inside and all(ok[a, b] for a, b in zip(p, p[1:]))]
    assert m.viterbi(e).shape == (6, 4)
    total = m._sums(np.ascontiguousarray(e.transpose(0, 2, 1)))[2]
    for n in range(6):
        scores = [sum(e[t, p[t], n] for t in range(4)) + sum(m.p["T"][a, b] for a, b in zip(p, p[1:])) for p in paths]
        assert tuple(m.viterbi(e)[n]) == paths[int(np.argmax(scores))]
        assert total[n] == pytest.approx(np.log(np.sum(np.exp(scores))), rel=1e-4)


@pytest.fixture(scope="module")
def network():
    rng = random.Random(10)
    prose = [words(rng, rng.randint(5, 30), 90).replace("w", "wo") for _ in range(60)]
    prose = [re.sub("[0-9]", lambda m: "abcdefghij"[int(m.group())], p) for p in prose]
    model = pii.BiLstmCrf()
    losses = model.train(*pii.labelled_windows(prose[:40], 1500, 3), epochs=6)
    assert losses[-1] < losses[0] / 5
    return model, prose[40:]


def test_network_finds_what_patterns_do_not(network):
    recall, precision = pii.span_recall(*network, 300, 77)
    assert recall > 0.75 and precision > 0.95


UNSEEN = [  # templates that the generator doesn't have: what is there, or nothing
    ("kindly reach marie dot dupont at gmail dot com before noon", "email"),
    ("his box: j_smith [at] uni-ulm [dot] de (office)", "email"),
    ("dial 0049 170 555 12 34 after six", "phone"),
    ("fax 555.867.5309 if the line is busy", "phone"),
    ("the card reads 4111.1111.1111.1111 on its face", "card"),
    ("gateway sits on 10 . 0 . 12 . 7 behind the wall", "ip"),
    ("card 4111 1111 1111 1112 was declined", None),
    ("item 12345678 is sold out", None),
    ("order number 1234567890123456 has shipped", None),
    ("they met at noon at the bar at last", None),
    ("Ating. At At At the house", None),
    ("version 300.400.500.600 of the tool", None),
    ("chapter 12. 13. 14. 15. of the book", None),
    ("serial 99887766554433221100 is stamped inside", None),
]


def test_kinds_are_checked():
    """What can't be of its kind is never added, whatever the network says; what can, may be."""
    assert not pii.plausible("email", "at at at at at") and not pii.plausible("email", "Ating. At At At") and not pii.plausible("email", "bob at home at last")
    assert pii.plausible("email", "marie dot dupont at gmail dot com") and pii.plausible("email", "x_y [at] host-a (dot) org") and pii.plausible("email", "a.b @ c . de")
    assert not pii.plausible("ip", "4111 1111 1111 1112") and not pii.plausible("ip", "300.1.1.1") and pii.plausible("ip", "10 . 0 dot 12[.]7")
    assert not pii.plausible("card", "1234567890123456") and not pii.plausible("card", "0000000000000000") and pii.plausible("card", "4lll.1111.1111.IIII")
    assert not pii.plausible("phone", "12345678") and not pii.plausible("phone", "1234567890") and pii.plausible("phone", "(385) 555-1563") and pii.plausible("phone", "0049 170 55512")


def test_unseen_templates(network):
    """Nothing that isn't personal is reported on lines of another make, and most of what is."""
    found = pii.model_spans(network[0], [t for t, _ in UNSEEN], 0.9)
    every = [{k for k, _, _ in own} | {k for k, _, _ in pii.pattern_spans(t)} for (t, _), own in zip(UNSEEN, found)]
    assert all(not kinds for (_, want), kinds in zip(UNSEEN, every) if want is None)
    assert all(kinds <= {want} for (_, want), kinds in zip(UNSEEN, every) if want)
    assert sum(want in kinds for (_, want), kinds in zip(UNSEEN, every) if want) >= 2


def test_windows_are_reconciled(network):
    """Spans come out the same wherever windows cut the text."""
    model, prose = network
    for lead in (60, 100, pii.STRIDE - 10, pii.STRIDE + 5, pii.WINDOW - 8, 3 * pii.WINDOW):
        text = (" ".join(prose) * 9)[:lead] + " password=9c82e4685ca7e2678401 " + prose[0]
        at = text.index("password")
        assert any(a < at + 6 and b > at + 20 for _, a, b in pii.model_spans(model, [text], 0.9)[0]), lead


def test_personal_data_edge_cases(docs, network):
    got = pii.find_personal_data(docs, model=network[0]).collect()
    assert len(got) == docs.count() and all(not any(s["pattern"] for s in r["spans"]) for r in got)


def test_pattern_spans_stay(spark, network):
    text = "write to a.b@c.example or +1 (385) 555-1563, server 10.2.3.4; password=9c82e4685ca7e26784 here"
    spans = pii.find_personal_data(table(spark, [text, text]), model=network[0]).collect()[0]["spans"]
    assert [(s["kind"], s["start"], s["end"]) for s in spans if s["pattern"]] == naive_spans(text)
    assert any(s["kind"] == "secret" for s in spans)


# ---- more of single operators


def test_estimate_matches_an_exhaustive_search():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(9, outliers.P)), rng.normal(size=(3, outliers.P)) + 8])
    h = int(0.75 * len(x))
    least = min(np.linalg.slogdet(np.cov(x[list(c)].T, bias=True) + outliers._floor())[1] for c in itertools.combinations(range(len(x)), h))
    assert np.linalg.slogdet(outliers.sample_mcd(x, 0.75, 200, 1)[1])[1] == pytest.approx(least, abs=1e-6)


def test_small_groups_share_their_languages_estimate(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(40, 80), 3000), "en" if i % 2 else "de", f"s{i % 40}", 0) for i in range(300)]
    rows += [(1000, "# $ % & " * 40 + words(rng, 40, 3000), "en", "s1", 0)]
    got = {r["doc_id"]: r for r in outliers.quality_rules(spark.createDataFrame(rows, DOC), carry=["lang"]).collect()}
    assert all(r["distance"] is not None for r in got.values()) and not got[1000]["kept"]
    assert sum(r["kept"] for r in got.values()) >= 290 and got[1000]["lang"] == "en"


def test_votes_match_brute_force():
    rng = np.random.default_rng(3)
    counts, labels, new = rng.poisson(0.4, (60, 40)).astype(np.float32), (rng.random(60) < 0.5).astype(float), rng.poisson(0.4, (25, 40)).astype(np.float32)
    model = neighbours.NeighbourModel(counts, labels, np.ones(40), 8, 5, 8.0)
    unit = lambda x: [v / max(np.linalg.norm(v), 1e-9) for v in neighbours.weighted(x, model.idf) @ model.directions]
    known, got = unit(counts), model.scores(new, block=7)
    for z, row, score in zip(unit(new), new, got):
        near = sorted(((float(z @ k), y) for k, y in zip(known, labels)), reverse=True)[:5]
        w = [max(s, 0) ** 8.0 for s, _ in near]
        want = (sum(a * y for a, (_, y) in zip(w, near)) + 0.05 * model.prior) / (sum(w) + 0.05) if row.sum() else model.prior
        assert score == pytest.approx(want, abs=1e-4)


def test_labels_of_repeated_ids_stay_bounded(spark):
    rng = random.Random(5)
    texts = [words(rng, 30) if i % 2 else "zz " * 30 for i in range(60)]
    ids = [i % 20 for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 3, "doc_id long, quality int")
    got = neighbours.classify_quality(table(spark, texts, ids), labels).collect()
    assert len(got) == 60 and all(0 <= r["score"] <= 1 for r in got)


def test_single_documents_are_read(spark, tmp_path):
    texts = words(random.Random(6), 400).split() + [None]
    ids = [7 * (i // 2) - 500 for i in range(400)] + [None]
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenfile.write_tokens(table(spark, texts, ids), str(tmp_path / "t"), path, max_docs=30)
    every = sorted((r["doc_id"], bytes(r["ids"])) for r in tokenfile.read_tokens(spark, str(tmp_path / "t")).collect() if r["doc_id"] is not None)
    wanted = [-500, -493, 4, 200, 893]
    got = sorted((r["doc_id"], bytes(r["ids"])) for r in tokenfile.read_documents(spark, str(tmp_path / "t"), wanted).collect())
    assert len(every) == 400 and got == [x for x in every if x[0] in wanted]


def test_many_parts_of_a_benchmark(spark):
    rng = random.Random(7)
    items = [words(rng, 12, 5000) for _ in range(30)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(99, items[3])], "item_id long, text string")
    texts = [words(rng, 20, 5000) + " " + items[i] + " " + words(rng, 5, 5000) for i in range(30)] + ["", None]
    a, b = ({r["doc_id"]: (r["n_hit"], r["item_ids"], r["spans"]) for r in decontaminate.decontaminate(table(spark, texts), bench, max_chars=n).collect()} for n in (10**6, 100))
    assert a == b and a[3][1] == ["3", "99"] and a[30][0] == 0


def test_very_long_texts(spark, network):
    """A million characters go through every operator whole."""
    rng = random.Random(13)
    pool = [f"w{i}x" for i in range(5000)]
    long = "\n".join(" ".join(rng.choices(pool, k=12)) for _ in range(14_000))
    item = " ".join(rng.choices(pool, k=12))
    texts = [long, long + "\nend " + item + " jo.smith@mail.example.com", "short one"]
    df = table(spark, texts)
    n = len(long.split())
    assert sorted(r["n_removed"] for r in substring_dedup.dedup_substrings(df, 20).collect()) == [0, 0, n]
    assert sorted(r["n_removed"] for r in chunks.dedup_chunks(df).collect()) == [0, 0, 14_000]
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_groups(df, 5, 80, 100).collect()} == {0: 0, 1: 0, 2: 2}
    assert sorted(r["n_words"] for r in outliers.quality_rules(df).collect()) == [2, n, n + 14]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["n_hit"] for r in decontaminate.decontaminate(df, bench).collect()) == [0, 0, 12]
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(df, model=network[0]).collect()}
    assert [(s["kind"], s["end"]) for s in found[1] if s["pattern"]] == [("email", len(texts[1]))]
    assert sorted(r["size"] for r in shard.interleave(df, 3).collect()) == sorted(len(t) + 8 for t in texts)


def test_repeated_ids_with_different_texts(spark):
    rng = random.Random(14)
    a, b = words(rng, 80, 3000), words(rng, 80, 3000)
    df = table(spark, [a, b, a, b + " x"], [1, 1, 2, 3])
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_groups(df, 5, 80, 100).collect()} == {1: 1, 2: 1, 3: 1}
    lines = ["one\ntwo\nthree", "four\nfive\nsix", "one\ntwo\nthree\nmore"]
    got = sorted((r["doc_id"], r["n_lines"], r["n_removed"]) for r in chunks.dedup_chunks(table(spark, lines, [5, 5, 6])).collect())
    assert got == [(5, 3, 0), (5, 3, 0), (6, 4, 3)]


# ---- the pipeline


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    item = " ".join(f"q{i}" for i in range(14))
    near = words(rng, 200, 3000)
    texts = [words(rng, 120, 3000) for _ in range(30)] + [near, near + " end", words(rng, 40, 3000) + " " + item, "too short", None]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(31))
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in got.items())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns


@pytest.mark.parametrize("n", [900, 3000])
@pytest.mark.parametrize("ids", ["own", "one", "none", "few"])
def test_outliers_go_whatever_the_ids(spark, n, ids):
    """Shared or absent ids neither take a group's estimate away nor save its outliers."""
    rng = random.Random(n)
    good = [". ".join(words(rng, rng.randint(8, 14), 4000) for _ in range(rng.randint(4, 9))) for _ in range(n)]
    bad = [" ".join(f"{w} ### $$$ |||" for w in words(rng, 40, 4000).split()) for _ in range(30)]
    of = {"own": lambda k: k, "one": lambda k: 77, "none": lambda k: None, "few": lambda k: k % 3}[ids]
    rows = [(of(k), t, "en", "web", len(t)) for k, t in enumerate(good + bad)]
    out = outliers.quality_rules(spark.createDataFrame(rows, DOC), carry=["text"]).filter("distance is not null").collect()
    assert len(out) == n + 30
    kept = [r["text"] for r in out if r["kept"]]
    assert not set(kept) & set(bad) and len(kept) >= n * 0.99


def test_rows_without_an_id_are_dealt_out(spark):
    """Ten thousand texts of one source, without an id or under one: no range of the shuffle holds many."""
    for ids in ([None] * 10_000, [5] * 10_000):
        docs = table(spark, [f"text {k}" for k in range(10_000)], ids).withColumn("source", F.lit("one"))
        got = shard.interleave(docs, 8, per_range=100)
        assert {r["shard"]: r["count"] for r in got.groupBy("shard").count().collect()} == {s: 1250 for s in range(8)}
        parts = [F.lit("brindle:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.octet_length(F.encode("text", "UTF-8")).cast("string"), F.lit(":"), F.crc32(F.encode("text", "UTF-8")).cast("string")]
        place = F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)
        assert docs.groupBy(F.floor(place * 100)).count().agg(F.max("count")).first()[0] < 200


@pytest.mark.parametrize("size", [100, 2000, 4000, 16000])
def test_signature_trees_prune_unrelated_sets_of_any_size(size):
    rng = np.random.default_rng(size)
    sets = [np.sort(rng.integers(0, 1 << 63, size).astype(np.uint64)) for _ in range(60)]
    sets[7] = sets[3].copy()
    sets[7][: size // 20] = rng.integers(0, 1 << 63, size // 20).astype(np.uint64)
    sets[7] = np.unique(sets[7])
    tree = ngram_join.SignatureTree(sets, np.arange(60))
    found = {(int(a), int(b)) for p, q in tree.pairs(80, 100) for a, b in zip(p, q)}
    assert (3, 7) in found and len(found) < 6


def test_long_and_short_sets_in_one_tree():
    """The bitmaps' memory bounds their width; links of long sets stay."""
    rng = np.random.default_rng(9)
    sets = sorted([np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in [30_000, 29_900, *rng.integers(1, 60, 3000)]], key=len)
    near = np.unique(np.concatenate([sets[-1][:29_000], sets[-2][:500]]))
    sets.append(near)
    sets.sort(key=len)
    tree = ngram_join.SignatureTree(sets, np.arange(len(sets)))
    assert tree.words * 8 * len(sets) <= max(32_000_000, 8 * 32 * len(sets))
    pairs = {(int(a), int(b)) for p, q in tree.pairs(80, 100) for a, b in zip(p, q)}
    brute = {(i, j) for i in range(len(sets) - 3, len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert brute and brute <= pairs
