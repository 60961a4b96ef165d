"""Line dedup by content-defined chunks, in DataFrame functions only.

A rolling hash over the hashes of two neighbouring lines decides where a chunk ends, so boundaries move with the
lines when something is put in front of them. Chunks of several lines that stood earlier in the corpus (smaller
doc_id, or the same document and an earlier line) are removed, after their bytes were compared; single lines stay.

That rule looks at the line before a chunk and runs on past the end of a shared passage, so short passages can slip
through. A second, finest level takes every two neighbouring lines as a chunk too: its ends depend on nothing outside
it, so any passage of two or more lines goes wherever its neighbouring lines stood together before, whatever is around
it. Of every line removed there is an earlier place, so its text stays at the first of them.

Chunks are cut once and their hashes written. Texts of the chunks whose hash repeats are fetched by document and grouped
by their bytes, with partial aggregation, so a passage that a third of all documents share is one row for each task.
What that gives is the first place of every such chunk; a document loses its repeated chunks but the first places among
them. So no join has a chunk as its key, but the one of hashes, whose sides are tables that can be split.

Defined results: a null text stays null with no lines; an empty text is one line; null ids count as the largest, and
equal ids go by a hash of their texts; rows that share id and text are one document and get the same result; an empty
table gives an empty result; other columns can be carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import written

_LAST = (1 << 63) - 1


def _bounded(df: DataFrame, every: int, pairs: bool) -> DataFrame:
    """df with _lines and _bounds: array of (start, length) of its chunks, and of every two neighbouring lines with pairs."""
    one_hash = "cast(conv(substring(md5(cast(l as binary)), 1, 8), 16, 10) as long)"
    df = df.withColumn("_lines", F.split("text", "\n", -1))
    df = df.withColumn("_h", F.expr(f"transform(_lines, l -> {one_hash})"))
    df = df.withColumn("_ends", F.expr(f"zip_with(_h, slice(concat(array(0L), _h), 1, size(_h)), (a, b) -> (a + 31 * b) % {every} = 0)"))
    df = df.withColumn("_starts", F.expr("filter(transform(slice(concat(array(true), _ends), 1, size(_ends)), (f, i) -> if(f, i, -1)), i -> i >= 0)"))
    df = df.withColumn("_bounds", F.expr("zip_with(_starts, slice(concat(_starts, array(size(_lines))), 2, size(_starts)), (a, b) -> struct(a as start, b - a as length))")).drop("_h", "_ends", "_starts")
    if pairs:
        two = "transform(slice(_lines, 2, size(_lines)), (l, i) -> struct(i as start, 2 as length))"
        df = df.withColumn("_bounds", F.expr(f"concat(filter(_bounds, b -> b.length <> 2), {two})"))
    return df


_CHUNK = "array_join(slice(_lines, _b.start + 1, _b.length), '\n')"


def _chunk_hashes(df: DataFrame, every: int, keys: list[str], pairs: bool) -> DataFrame:
    """keys, _b (start, length), _hash: the chunks of several lines."""
    rows = _bounded(df, every, pairs).select(*keys, "_lines", F.explode(F.expr("filter(_bounds, b -> b.length > 1)")).alias("_b"))
    return rows.select(*keys, "_b", F.xxhash64(F.expr(_CHUNK)).alias("_hash"))


def _matched(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left joined with right on (doc_id, _text), null ids included."""
    right = right.withColumnsRenamed({"doc_id": "_right_id", "_text": "_right_text"})
    joined = left.join(right, left["doc_id"].eqNullSafe(right["_right_id"]) & (left["_text"] == right["_right_text"]), how)
    return joined.drop("_right_id", "_right_text")


def dedup_chunks(docs: DataFrame, every: int = 3, *, pairs: bool = True, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (without the repeated chunks), n_lines, n_removed (lines), and the columns named in carry.

    every: a chunk ends at one line in so many. pairs: every two neighbouring lines are a chunk too.
    """
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0)).alias("_text"),
        F.col(text_col).cast("string").alias("text"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )
    keys = ["doc_id", "_text"]
    base = docs.select(*keys, "text")
    hashed = written(_chunk_hashes(base, every, keys, pairs), "chunks")
    repeated = written(hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_hash"), "repeated")
    # both sides are tables, so adaptive execution can split a hash that very many documents hold
    wanted = written(hashed.join(repeated.hint("merge"), "_hash", "left_semi").groupBy(*keys).agg(F.collect_set("_b").alias("_wanted")), "wanted")
    fetched = _matched(base, wanted, "inner").select(*keys, F.split("text", "\n", -1).alias("_lines"), F.explode("_wanted").alias("_b"))
    place = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.col("_text"), F.col("_b.start").alias("start"), F.col("_b.length").alias("length"), F.col("doc_id").alias("own"))
    first = fetched.select(place.alias("_place"), F.expr(_CHUNK).alias("chunk")).groupBy("chunk").agg(F.min("_place").alias("_first"))
    stays = first.select(F.col("_first.own").alias("doc_id"), F.col("_first._text").alias("_text"), F.struct("_first.start", "_first.length").alias("_b"))
    stays = stays.groupBy(*keys).agg(F.collect_set("_b").alias("_firsts"))
    later = _matched(wanted, stays, "left").select(*keys, F.expr("array_except(_wanted, coalesce(_firsts, filter(_wanted, b -> false)))").alias("_later")).filter("size(_later) > 0")
    gone = later.select(*keys, F.expr("array_distinct(flatten(transform(_later, b -> sequence(b.start, b.start + b.length - 1))))").alias("_gone"))
    out = _matched(docs, gone, "left").withColumn("_lines", F.split("text", "\n", -1))
    out = out.withColumn("_stay", F.expr("array_except(sequence(0, size(_lines) - 1), _gone)"))
    kept = F.expr("array_join(transform(_stay, i -> get(_lines, i)), '\n')")
    return out.select(
        "doc_id",
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_lines") - F.size("_stay")).cast("long").alias("n_removed"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )
