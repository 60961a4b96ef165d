"""Host reputations, fill-in-the-middle and collocations against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.llm import fim, hosts, phrases

# ---- 11: urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return low, re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def names(host):
    bare = re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", host))
    labels = bare.split(".")
    if len(labels) < 2 or re.fullmatch(r"[0-9.]+", bare):
        return "", bare
    k = 2 if len(labels) > 2 and ".".join(labels[-2:]) in hosts.WIDE_SUFFIXES else 1
    return ".".join(labels[-k:]), ".".join(labels[-k - 1 :])


def brute_reputations(pages, bad):
    n, k = Counter(), Counter()
    for page, host in pages:
        n[host] += page in bad
        k[host] += bad.get(page, 0)
    parent = {h: names(h) for h in {h for _, h in pages}}
    dn, dk, sn, sk = Counter(), Counter(), Counter(), Counter()
    for h, (s, d) in parent.items():
        dn[s, d] += n[h]
        dk[s, d] += k[h]
        sn[s] += n[h]
        sk[s] += k[h]

    def weight(children, n, k, parent_of):
        x = c = 0.0
        for p in {parent_of(i) for i in children}:
            own = [i for i in children if parent_of(i) == p and n[i]]
            total, bad_ones = sum(n[i] for i in own), sum(k[i] for i in own)
            if len(own) > 1 and 0 < bad_ones < total:
                share = bad_ones / total
                x += sum(n[i] * (k[i] / n[i] - share) ** 2 for i in own) / (share * (1 - share)) - len(own) + 1
                c += total - sum(n[i] ** 2 for i in own) / total - len(own) + 1
        return 1 / min(1 / 2, max(1 / 1001, x / c if c else 1 / 11)) - 1

    ws, wd, wh = weight(list(sn), sn, sk, lambda i: 0), weight(list(dn), dn, dk, lambda i: i[0]), weight(list(parent), n, k, lambda h: parent[h][1])
    all_n, all_k, out = sum(n.values()), sum(k.values()), {}
    for h, (s, d) in parent.items():
        prior = (all_k - sk[s] + 1) / (all_n - sn[s] + 2)
        prior = (sk[s] - dk[s, d] + ws * prior) / (sn[s] - dn[s, d] + ws)
        prior = (dk[s, d] - k[h] + wd * prior) / (dn[s, d] - n[h] + wd)
        share = (k[h] + wh * prior) / (n[h] + wh)
        out[h] = share, (share - 3 * math.sqrt(share * (1 - share) / (n[h] + wh + 1))) if all_n else None
    return out


def brute_verdicts(rows, bad):
    parsed = [(p, *split_url(u)) for p, u in rows]
    known = brute_reputations([(p, h) for p, h, _ in parsed], bad)
    out = []
    for page, host, path in parsed:
        fits = [(own + pre, says) for own, pre, says in RULES if (host == own or host.endswith("." + own)) and path.startswith(pre)]
        rule, verdict = max(fits, key=lambda r: len(r[0])) if fits else (None, None)
        share, bound = known[host]
        out.append((page, host, path, rule, verdict or ("block" if bound is not None and bound > 0.5 else "allow"), round(share, 9), bound if bound is None else round(bound, 9)))
    return sorted(out, key=str)


URLS = [
    None, "", "no url", "http://", "http://a.example.net/en/x?q=1#f", "HTTPS://A.Example.NET/EN/x", "http://example.net", "http://net/x", "http://xnet/x", "http://b.example.com/de/1", "http://b.example.com/dey",
    "http://c.org/fr/", "http://c.org:80/fr/", "http://u@c.org/fr/a", "http://c.org?x=/fr/", "http://c.org#/fr/", "x://y://z.org/fr/1", "http://10.0.0.1/a", "http://ÄB.example.co.uk/p\nq", "http://localhost/x",
]


def pages_of(seed, n=20_000):
    rng = random.Random(seed)
    rows = [(i, u) for i, u in enumerate(URLS)]
    for i in range(len(URLS), n):
        host = "hot.shop.com" if rng.random() < 0.35 else f"h{rng.randrange(6)}.d{rng.randrange(5)}.{rng.choice(['com', 'org', 'co.uk'])}"
        rows.append((i, f"http://{host}/p{i}"))
    evil = re.compile(r"d1\.org|h2\.d3\.")
    bad = {i: int(rng.random() < (0.95 if evil.search(u or "") else 0.1)) for i, u in rows if rng.random() < 0.4}
    return rows, bad


@pytest.mark.parametrize("case", ["mixed", "no labels", "repeats", "empty"])
def test_urls_match_brute_force(spark, case):
    rows, bad = pages_of(3)
    bad = {} if case == "no labels" else bad
    if case == "repeats":
        rows = rows + rows[:50] + [(None, u) for u in URLS]
    rows = [] if case == "empty" else rows
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "n": F.lit("x"), "verdict": F.lit(None)})
    twice = [(i, bool(b)) for i, b in bad.items()] + [(i, False) for i in list(bad)[:20]] + [(None, True), (1, None)]
    labels = spark.createDataFrame(twice if case != "no labels" else [], "page_id long, bad boolean").withColumn("k", F.lit(9))
    got = hosts.filter_urls(pages, labels, RULES).collect()
    want = brute_verdicts(rows, bad)
    assert sorted([(r[0], r[1], r[2], r[3], r[4], round(r[5], 9), r[6] if r[6] is None else round(r[6], 9)) for r in got], key=str) == want
    if case == "mixed":
        by_host = {r["host"]: r["verdict"] for r in got if r["rule"] is None}
        assert by_host["h1.d1.org"] == "block" and by_host["h2.d3.com"] == "block" and by_host["hot.shop.com"] == "allow" and by_host["h0.d0.com"] == "allow"


def test_relatives_judge_a_host_without_labels(spark):
    """A new host of a bad domain leans to its relatives; its own pages are not in its prior."""
    rows = [(i, f"http://h{i % 8}.bad.com/{i}") for i in range(400)] + [(1000 + i, f"http://h{i % 8}.good.com/{i}") for i in range(400)] + [(5000, "http://new.bad.com/"), (5001, "http://new.good.com/"), (5002, "http://new.other.com/")]
    labels = [(i, True) for i in range(400)] + [(1000 + i, i % 40 == 0) for i in range(400)]
    out = hosts.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean"))
    share = {r["host"]: r["bad_share"] for r in out.filter("page_id >= 5000").collect()}
    assert share["new.bad.com"] > 0.9 and share["new.good.com"] < 0.1 and 0.2 < share["new.other.com"] < 0.8
    assert {r["verdict"] for r in out.filter("host like '%.bad.com'").collect()} >= {"block"}


# ---- 12: fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "\n\n", "one", " one", "one ", "é ü", "a <P> b", "<S>", "x<M", "<P", "P>", "a\x85b\u00a0c", "𝒳 y  𝒵\t", "x" * 5000, " " * 2000, "w " * 3000, "<" * 50 + " ><P" + " S>"]


def brute_fim(text, doc_id):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [1, 3, 64, 512])
def test_block_tree_finds_every_cut(block):
    rng = random.Random(block)
    for text in [t for t in TEXTS if t and len(t) < 200] + ["".join(rng.choice(" \n\tabé𝒳<") for _ in range(rng.randrange(400))) for _ in range(30)]:
        tree, units = fim.BlockTree(text.encode(), block), UNIT.findall(text)
        assert tree.n == len(units)
        for k in range(len(units) + 1):
            front = "".join(units[:k])
            assert tree.cut(k) == (len(front.encode()), len(front))


def test_fill_in_middle_and_back(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice(" \n\tabé𝒳<PSM>") for _ in range(rng.randrange(300))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here"), (7, "another text of one id"), (7, "another text of one id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "output": F.lit("x"), "form": F.lit(2)})
    out = fim.restored(fim.fill_in_middle(docs.repartition(4))).collect()
    key = lambda r: (str(r[0]), r[-1], str(r))
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["text"]) for r in out), key=key) == sorted(((i, *brute_fim(t, i), t or "") for i, t in rows), key=key)
    assert {r["form"] for r in out} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


# ---- 13: phrases


def brute_phrases(rows, support, top, inside=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found, out = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= support}, []
    for (g, p), a in found.items():
        if len(p) == 2 and any(h == g and len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= inside * a for (h, q), b in found.items()):
            continue
        score, k = min((1000000 * a * a // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p)))
        out.append((g, " ".join(p), a, f[g, p[:k]], f[g, p[k:]], n[g], score))
    ranked = []
    for g in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == g), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(g, i, *x[1:]) for i, x in enumerate(own[:top], 1)]
    return sorted(ranked)


def phrase_rows(seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)] + ["Élan", "été", "NEW", "new", "a-b", "x\x85y"]
    seps = [" "] * 12 + ["\t", "  ", ". ", ", ", "\n", "; ", "!", " ? ", "\x0b"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(pool[: rng.choice([6, 20, 66])]) + rng.choice(seps) for _ in range(rng.choice([0, 1, 2, 8, 60, 400])))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, " .,; "), ("en", "same same same " * 40), ("fr", "one two three. " * 9), ("de", "y" * 3000 + " z")]
    return rows + [("en", "the quick fox jumps")] * 500 + [("it", "hot key. hot key,hot key")] * 30


@pytest.mark.parametrize("shards", [1, 4, 7])
def test_phrases_match_brute_force(spark, shards):
    rows = phrase_rows(shards)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"n": F.lit(1), "phrase": F.lit("x"), "shard": F.lit(2)}).repartition(5)
    for support, top in ((10, 2000), (3, 15)):
        got = sorted(tuple(r) for r in phrases.collocations(docs, support, top, shards=shards, salts=3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == brute_phrases(rows, support, top)


def test_phrases_with_a_full_filter_stay_exact(spark):
    rows = phrase_rows(2)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in phrases.collocations(docs, 10, 50, filter_bits=6).collect())
    assert got == brute_phrases(rows, 10, 50)


def shuffled_records(spark):
    """Rows that all stages so far wrote to shuffles."""
    sc = spark.sparkContext
    store, quantiles = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._gateway.jvm.double, 0)
    stages = store.stageList(None, False, False, quantiles, sc._gateway.jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_phrases_travel_packed(spark):
    """40,000 different words once each: they don't become a shuffled row each."""
    rows = [("en", " ".join(f"w{i}x{k}" for k in range(100))) for i in range(400)]
    docs = spark.createDataFrame(rows + [("en", "two words. " * 12)], "lang string, text string").coalesce(1)
    before = shuffled_records(spark)
    assert [tuple(r) for r in phrases.collocations(docs, 10, 50).collect()] == brute_phrases(rows + [("en", "two words. " * 12)], 10, 50)
    assert sum(n for stage, n in shuffled_records(spark).items() if stage not in before) < 10_000


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), ("en", ".")], "lang string, text string")).count() == 0
