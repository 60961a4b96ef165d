"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, chunks, decontaminate, fim, hosts, neighbours, ngram_join, outliers, phrases, pii, shard, substring_dedup, tokenfile
from brindle.llm.common import shared_dir


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.classify_quality(_docs(spark, sf_dir), _docs(spark, sf_dir, "labels"))


def op2_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_rules(_docs(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.dedup_chunks(_docs(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(_docs(spark, sf_dir))
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = "filter(spans, s -> s.pattern)"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.pattern and s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.PATTERN_KINDS]
    more = [F.expr("cast(size(filter(spans, s -> not s.pattern)) as long)").alias("n_added"), F.size("spans").cast("long").alias("n_spans")]
    return out.select("doc_id", *counts, F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"), *more)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(_docs(spark, sf_dir), 20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_docs(spark, sf_dir), _docs(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_groups(_docs(spark, sf_dir), 4, 85, 100)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vocabulary("byte_bpe_50k.json")
    out = bpe.round_trip(_docs(spark, sf_dir), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op9_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/brindle-tokens-{uuid.uuid4().hex}"
    tokenfile.write_tokens(_docs(spark, sf_dir), path, _vocabulary("word_bpe_49k.json"))
    return tokenfile.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard.interleave(_docs(spark, sf_dir), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Rules of the query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled page is bad if its label has quality 0 or is toxic."""
    labels = _docs(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    out = hosts.filter_urls(_docs(spark, sf_dir, "pages"), labels, RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("bad_share", 6).alias("bad_share"), F.round("bound", 6).alias("bound"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.restored(fim.fill_in_middle(_docs(spark, sf_dir)))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("text").alias("restored_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_docs(spark, sf_dir), 10, 2000)


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_outliers": op2_outliers,
    "op3_line_chunks": op3_line_chunks,
    "op4_personal_data": op4_personal_data,
    "op5_substrings": op5_substrings,
    "op6_decontaminate": op6_decontaminate,
    "op7_ngram_join": op7_ngram_join,
    "op8_bpe": op8_bpe,
    "op9_tokenfile": op9_tokenfile,
    "op10_interleave": op10_interleave,
    "op11_url_filter": op11_url_filter,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_collocations": op13_collocations,
}

#: Both levels: chunks that lines choose, and every two neighbouring lines.
_OP3 = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM l),
h AS (SELECT *, CAST('0x' || left(md5(line), 8) AS BIGINT) AS h FROM e),
c AS (SELECT *, (h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 3 = 0 AS ends FROM h),
g AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM c),
k AS (SELECT doc_id, min(i) AS s, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM g GROUP BY doc_id, g HAVING count(*) > 2
      UNION ALL SELECT doc_id, i, 2, line || chr(10) || next FROM g WHERE next IS NOT NULL),
r AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) > 1 AS gone FROM k),
o AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS i FROM r WHERE gone)
SELECT e.doc_id, count(*) AS n_lines, count(o.i) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY e.i) FILTER (WHERE o.i IS NULL), '')) AS kept_sha256
FROM e LEFT JOIN o ON o.doc_id = e.doc_id AND o.i = e.i GROUP BY e.doc_id
"""

_OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.v WHERE r.m < e.b),
c AS (SELECT v, min(m) AS m FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.v = d.doc_id
"""

#: The crc32 is computed byte by byte over the table of its 256 remainders.
_OP10 = """
WITH tbl AS (SELECT list_transform(range(0, 256), lambda v: list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v)) AS t),
d AS (SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS no_source, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, s, no_source, len(x) // 2 + 8 AS size,
             xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) AS crc FROM d, tbl),
r AS (SELECT *, row_number() OVER (PARTITION BY s, no_source ORDER BY md5('brindle:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || (size - 8) || ':' || crc), size, crc, doc_id) AS rk, count(*) OVER (PARTITION BY s, no_source) AS n FROM b),
p AS (SELECT *, row_number() OVER (ORDER BY (rk - 0.5::DOUBLE) / n::DOUBLE, CASE WHEN no_source THEN '' ELSE '=' || s END, rk) - 1 AS p, count(*) OVER () AS total FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p * 24 // total AS INT) AS shard,
       CAST(p - ((p * 24 // total) * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""

_OP5 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) > 1 AS later FROM i),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT p.doc_id, p.i, p.word, coalesce(max(CAST(later AS INT)) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM p LEFT JOIN k ON k.doc_id = p.doc_id AND k.i = p.i),
s AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS t FROM g GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
hit AS (SELECT di.doc_id, di.i, di.n, bw.item_id FROM di JOIN bw ON bw.n = di.n AND bw.k = array_to_string(di.w[di.i:di.i + di.n - 1], ' ')),
places AS (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM places GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_WIDE = ", ".join(f"'{s}'" for s in hosts.WIDE_SUFFIXES)

#: The weight of a level's priors, from sums over the children of each parent.
_WEIGHT = """SELECT 1 / least(1 / 2, greatest(1 / 1001, CASE WHEN coalesce(sum(c), 0) <> 0 THEN sum(x) / sum(c) ELSE 1 / 11 END)) - 1 AS w
FROM (SELECT (sum(k * k / n) - sum(k) * sum(k) / sum(n)) / (sum(k) / sum(n) * (1 - sum(k) / sum(n))) - (count(*) - 1) AS x, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS c
      FROM {} WHERE n > 0 GROUP BY {} HAVING count(*) > 1 AND sum(k) > 0 AND sum(k) < sum(n))"""

_OP11 = rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
b AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h0 AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM p LEFT JOIN b ON b.doc_id = p.page_id GROUP BY host),
h1 AS (SELECT *, string_split(bare, '.') AS ls, len(string_split(bare, '.')) < 2 OR regexp_matches(bare, '^[0-9.]+$') AS alone FROM h0),
h2 AS (SELECT *, CASE WHEN len(ls) > 2 AND array_to_string(ls[-2:], '.') IN ({_WIDE}) THEN 2 ELSE 1 END AS w FROM h1),
h AS (SELECT host, n, k, CASE WHEN alone THEN '' ELSE array_to_string(ls[-w:], '.') END AS suffix, CASE WHEN alone THEN bare ELSE array_to_string(ls[-w - 1:], '.') END AS domain FROM h2),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, 0 AS one FROM d GROUP BY suffix),
g AS (SELECT sum(n) AS n, sum(k) AS k FROM s),
ws AS ({_WEIGHT.format('s', 'one')}), wd AS ({_WEIGHT.format('d', 'suffix')}), wh AS ({_WEIGHT.format('h', 'domain')}),
m1 AS (SELECT h.host, h.n, h.k, d.n AS dn, d.k AS dk, (s.k - d.k + ws.w * (g.k - s.k + 1) / (g.n - s.n + 2)) / (s.n - d.n + ws.w) AS m, wd.w AS wd, wh.w AS wh, g.n AS gn
       FROM h JOIN d USING (suffix, domain) JOIN s USING (suffix), g, ws, wd, wh),
m2 AS (SELECT *, (k + wh * (dk - k + wd * m) / (dn - n + wd)) / (n + wh) AS share FROM m1),
m3 AS (SELECT host, share, CASE WHEN gn > 0 THEN share - 3 * sqrt(share * (1 - share) / (n + wh + 1)) END AS bound FROM m2),
r AS (SELECT p.*, share, bound, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                   WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                   WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                   WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p JOIN m3 USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       round(share, 6) AS bad_share, round(bound, 6) AS bound FROM r
"""

_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST(len(t) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS m,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
k AS (SELECT *, CASE WHEN p > 0 THEN array_to_string(t[1:p], '') ELSE '' END AS prefix, CASE WHEN m > p THEN array_to_string(t[p + 1:m], '') ELSE '' END AS middle, CASE WHEN n > m THEN array_to_string(t[m + 1:n], '') ELSE '' END AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM k
"""

_OP13 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
x AS (SELECT lang, p, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
y AS (SELECT lang, word, lead(word) OVER (PARTITION BY p ORDER BY i) AS w2, lead(word, 2) OVER (PARTITION BY p ORDER BY i) AS w3 FROM x),
g AS (SELECT lang, 1 AS k, word AS phrase FROM y UNION ALL SELECT lang, 2, word || ' ' || w2 FROM y WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, word || ' ' || w2 || ' ' || w3 FROM y WHERE w3 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, phrase, lang || chr(10) || phrase AS id, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS p FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, words, phrase, a, p, unnest(range(1, words)) AS k FROM c),
sc AS (SELECT cut.lang, cut.words, cut.phrase, a, cut.k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
       FROM cut JOIN f x ON x.id = cut.lang || chr(10) || array_to_string(p[1:cut.k], ' ') JOIN f y ON y.id = cut.lang || chr(10) || array_to_string(p[cut.k + 1:], ' ')),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
lo AS (SELECT lang, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase, a FROM c WHERE words = 3),
ar AS (SELECT lang, phrase, max(a) AS around FROM lo GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN ar USING (lang, phrase) WHERE around IS NULL OR 100 * around < 50 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept JOIN n ON n.lang = kept.lang
QUALIFY rank <= 2000
"""

ORACLES = {"op3_line_chunks": _OP3, "op5_substrings": _OP5, "op6_decontaminate": _OP6, "op7_ngram_join": _OP7, "op10_interleave": _OP10, "op11_url_filter": _OP11, "op12_fill_in_middle": _OP12, "op13_collocations": _OP13}


def queries() -> dict:
    """Name -> query over (spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL, where SQL can express the query."""
    return dict(ORACLES)
