"""Quality rules: robust multivariate outliers by minimum covariance determinants per language and source.

Each text gives counts; their transforms are a vector. For every (language, source) the subset of h rows whose
covariance has the smallest determinant is sought: many starts on a bounded sample of the group, then concentration
steps over all rows of the group as Spark aggregations, until no group's determinant falls any more. Equal vectors are
one row with their number of copies from the start, and the sample goes by content, never by id. Rows whose
Mahalanobis distance under the estimate exceeds a chi-square quantile are rejected. A concentration step is one
aggregation by group and distance bin, so no group is gathered: the bins that hold the h nearest rows give the next
mean and covariance.

Defined results: a null text has no words; null languages and sources are values of their own; groups under min_rows
share one estimate with the small groups of their language, and where those are fewer than min_rows together, with the
small groups of all languages; if even they are fewer, only the base rules decide; rows without words get no distance;
ids are only passed on, so null or shared ids change nothing; repeated rows get equal results; an empty table gives an empty result; texts of any length are
counted whole; other columns can be carried along, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import discard, give_back, text_groups, window_hashes, word_hashes, written, written_at

_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Name and smallest standard deviation of each transformed statistic: shares that are zero in most texts have no spread
#: of their own. The word length is a mean with 20 words of 5 characters added, so few words don't make an outlier.
FEATURES = {"log_words": 0.3, "word_length": 0.3, "symbol_share": 0.05, "dup_line_share": 0.08, "repeat_share": 0.05}
P = len(FEATURES)
_BINS = 24
#: Concentration of a group ends when its log determinant falls by no more than this.
_SETTLED = 1e-3


def repeated_words(hashes: np.ndarray, words: list[bytes], k: int = 5) -> int:
    """Words inside k-word windows that occur twice or more in the text."""
    windows = window_hashes(hashes, k)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    sorted_ = windows[order]
    same = sorted_[1:] == sorted_[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    for a, b in zip(order[:-1][same].tolist(), order[1:][same].tolist()):  # equal hashes are compared word by word
        if words[a : a + k] == words[b : b + k]:
            twice[a] = twice[b] = True
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def text_counts(texts: list[str | None]) -> dict[str, list[int]]:
    """The counts of each text."""
    raw = [(t or "").encode() for t in texts]
    hashes, at = word_hashes(raw)
    out: dict[str, list[int]] = {c: [] for c in _STATS}
    for i, (text, data) in enumerate(zip(texts, raw)):
        words = data.split()
        lines = text.split("\n") if text else []
        full = [x for x in lines if x.encode().strip()] if lines else []
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")) if text else 0)
        out["n_symbols"].append(int(_SYMBOLS[np.frombuffer(data, np.uint8)].sum()))
        out["n_dup_lines"].append(len(full) - len(set(full)))
        out["n_repeat_words"].append(repeated_words(hashes[at[i] : at[i + 1]], words))
        out["n_lines"].append(len(full))
    return out


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the counts of every text, and the columns named in carry as _carry_<name>: a map over the rows."""
    carried = [F.col(c).alias(f"_carry_{c}") for c in carry]

    def run(batches):
        for batch, texts in text_groups(batches):
            counts = text_counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *[pa.array(counts[c], pa.int64()) for c in _STATS], *batch.columns[4:]], ["doc_id", "lang", "source", *_STATS, *batch.schema.names[4:]])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), *carried)
    fields = rows.schema.fields
    schema = T.StructType([fields[0], *fields[2:4], *[T.StructField(c, T.LongType()) for c in _STATS], *fields[4:]])
    return rows.mapInArrow(run, schema)


# ---------------------------------------------------------------- the estimate


def chi_square_below(x: float, p: int) -> float:
    """P(chi-square with p degrees of freedom <= x), by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = p / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi_square_quantile(share: float, p: int) -> float:
    """The x below which the given share lies."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_below(mid, p) < share else (lo, mid)
    return hi


def _floor() -> np.ndarray:
    return np.diag(np.square(np.array(list(FEATURES.values()))))


def _distances(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    z = np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T)
    return (z * z).sum(0)


def sample_mcd(x: np.ndarray, share: float, starts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (with the floor) of the h rows whose covariance has the smallest determinant, from random starts with concentration steps."""
    rng, n = np.random.default_rng(seed), len(x)
    h, found = max(P + 1, int(share * n)), []

    def step(mean, cov):
        near = np.argpartition(_distances(x, mean, cov), h - 1)[:h]
        return x[near].mean(0), np.cov(x[near].T, bias=True) + _floor()

    for _ in range(starts):
        own = x[rng.choice(n, min(n, P + 1), replace=False)]
        mean, cov = own.mean(0), np.cov(own.T, bias=True) + _floor()
        for _ in range(2):
            mean, cov = step(mean, cov)
        found.append((np.linalg.slogdet(cov)[1], mean, cov))
    found.sort(key=lambda f: f[0])
    best = None
    for det, mean, cov in found[:10]:
        for _ in range(30):
            new_mean, new_cov = step(mean, cov)
            new = np.linalg.slogdet(new_cov)[1]
            mean, cov = new_mean, new_cov
            if new >= det - 1e-10:
                break
            det = new
        if best is None or det < best[0]:
            best = (det, mean, cov)
    return best[1], best[2]


_ESTIMATE = "_group string, mean array<double>, inverse array<double>, logdet double, fell double"


def _row(group: str, mean: np.ndarray, cov: np.ndarray, before: float) -> pd.DataFrame:
    """before: the last log determinant; fell tells by how much it fell."""
    logdet = float(np.linalg.slogdet(cov)[1])
    return pd.DataFrame({"_group": [group], "mean": [mean.tolist()], "inverse": [np.linalg.inv(cov).ravel().tolist()], "logdet": [logdet], "fell": [before - logdet]})


def _distance() -> Column:
    """Squared Mahalanobis distance from columns x, mean and inverse."""
    d = [f"(x[{i}] - mean[{i}])" for i in range(P)]
    return F.expr(" + ".join(f"{'' if i == j else '2 * '}inverse[{i * P + j}] * {d[i]} * {d[j]}" for i in range(P) for j in range(i, P)))


def _concentrated(vectors: DataFrame, estimates: DataFrame, share: float) -> DataFrame:
    """One concentration step over all rows."""
    moved = [f"(x[{i}] - mean[{i}])" for i in range(P)]
    pairs = [(i, j) for i in range(P) for j in range(i, P)]
    rows = vectors.join(estimates, "_group").withColumn("_bin", F.floor(F.log2(_distance() + 1e-6) * _BINS))
    sums = rows.groupBy("_group", "_bin").agg(
        F.sum("_copies").alias("c"),
        *[F.sum(F.expr(f"_copies * {moved[i]}")).alias(f"s{i}") for i in range(P)],
        *[F.sum(F.expr(f"_copies * {moved[i]} * {moved[j]}")).alias(f"q{i}_{j}") for i, j in pairs],
    )
    sums = sums.join(estimates.select("_group", "mean", "inverse", "logdet"), "_group")

    def update(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_bin")
        stop = int(np.searchsorted(pdf["c"].cumsum().to_numpy(), max(P + 1, int(share * pdf["c"].sum())))) + 1
        near = pdf.iloc[:stop]
        c = near["c"].sum()
        shift = np.array([near[f"s{i}"].sum() / c for i in range(P)])
        cov = np.zeros((P, P))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = near[f"q{i}_{j}"].sum() / c - shift[i] * shift[j]
        out = _row(pdf["_group"].iloc[0], np.array(pdf["mean"].iloc[0]) + shift, cov + _floor(), float(pdf["logdet"].iloc[0]))
        if out["fell"].iloc[0] < 0:  # a step by bins may overshoot where a group is small: then the estimate before it stays
            out = pdf[["_group", "mean", "inverse", "logdet"]].head(1).assign(fell=0.0)
        return out

    return sums.groupBy("_group").applyInPandas(update, _ESTIMATE).coalesce(vectors.sparkSession.sparkContext.defaultParallelism)  # a row a group


def _sampled(vectors: DataFrame, rows: int) -> DataFrame:
    """About so many rows of each group, or all if it has fewer, as (_group, x, _key); chosen by content alone.

    The c copies of a vector lie at one hashed place in each c-th of the range from 0 to 1, and the rows nearest to 0 are
    drawn. So ids, shared or null, play no part, a vector is drawn in proportion to its copies, and what is drawn of a
    group is bounded however its rows repeat.
    """
    reach = (rows + 5 * math.sqrt(rows)) / F.col("_of")
    copies = F.least(F.col("_copies"), F.floor(F.col("_copies") * reach) + 1)
    drawn = vectors.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    place = F.pmod(F.xxhash64("x", "_copy"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    drawn = drawn.withColumn("_key", (F.col("_copy") - 1 + place) / F.col("_copies"))
    return drawn.filter(F.col("_key") < reach).select("_group", "x", "_key")


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    share: float = 0.75,
    quantile: float = 1 - 1e-7,
    min_rows: int = 60,
    sample_rows: int = 500,
    starts: int = 120,
    steps: int = 60,
    carry: list[str] | tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared, null where there is no estimate), kept, and the columns named in carry, of every row.

    share: of a group's rows that the estimate rests on. quantile: of the chi-square law that a kept row may reach.
    sample_rows: bound of the sample on which the starts are tried; the steps after them use all rows. steps: a stop for
    concentration that doesn't settle, far above what is needed; reaching it is an error.
    """
    counts = written(document_counts(docs, id_col, text_col, lang_col, source_col, carry), "counts")
    name = F.concat(*[F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.length(c).cast("string"), F.lit(":"), F.col(c))) for c in ("lang", "source")])
    words = F.col("n_words").cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    x = F.array(F.log1p(words), (F.col("word_chars") + 100) / (words + 20), F.col("n_symbols") / words, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words)
    rows = counts.withColumn("_name", name)
    with_words = rows.filter("n_words > 0")
    sizes = with_words.groupBy("_name").agg(F.first(F.coalesce("lang", F.lit(""))).alias("_lang"), F.count(F.lit(1)).alias("_size"))
    small = F.col("_size") < min_rows
    of_lang, of_all = Window.partitionBy("_lang", small), Window.partitionBy(F.col("_group").isNull())
    sizes = sizes.withColumn("_pool", F.sum("_size").over(of_lang)).select(
        "_name",
        "_size",
        F.when(~small, F.concat(F.lit("="), "_name")).when(F.col("_pool") >= min_rows, F.concat(F.lit("~"), "_lang")).alias("_group"),
        F.when(~small, F.col("_size")).otherwise(F.col("_pool")).alias("_of"),
    )  # one row a language and source: windows over them are small
    rest = F.when(F.col("_group").isNull(), F.sum("_size").over(of_all))
    of = sizes.withColumn("_rest", rest).select("_name", F.coalesce("_group", F.when(F.col("_rest") >= min_rows, F.lit(""))).alias("_group"), F.coalesce("_rest", "_of").alias("_of"))
    of = written(of, "group-sizes")
    vectors = with_words.join(of, "_name").filter(F.col("_group").isNotNull()).groupBy("_group", "_of", x.alias("x")).agg(F.count(F.lit(1)).alias("_copies"))
    vectors = written(vectors, "vectors")

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key").head(sample_rows)
        return _row(pdf["_group"].iloc[0], *sample_mcd(np.stack(pdf["x"].to_numpy()), share, starts, 11), float("inf"))

    estimates, path = written_at(_sampled(vectors, sample_rows).groupBy("_group").applyInPandas(first, _ESTIMATE), "estimates")
    for _ in range(steps):
        moving = estimates.filter(f"fell > {_SETTLED}")
        if moving.isEmpty():
            break
        stepped = _concentrated(vectors, moving, share).unionByName(estimates.filter(f"not fell > {_SETTLED}"))
        (estimates, new), old = written_at(stepped, "estimates"), path
        discard(docs.sparkSession, old)
        path = new
    else:
        raise RuntimeError(f"determinants still fall after {steps} concentration steps")

    inner = chi_square_quantile(share, P)
    factor = share / chi_square_below(inner, P + 2)  # makes the covariance of the nearest rows that of all rows, for normal vectors
    cutoff = chi_square_quantile(quantile, P)
    judged = rows.join(of.select("_name", "_group"), "_name", "left").join(estimates.select("_group", "mean", "inverse"), "_group", "left").withColumn("x", F.when(F.col("n_words") > 0, x))
    judged = judged.withColumn("distance", _distance() / factor)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", *_STATS, failed.alias("base_failed"), "distance", (~failed & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"), *[F.col(f"_carry_{c}").alias(c) for c in carry])
