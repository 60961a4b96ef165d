"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Texts become tf-idf vectors of hashed byte trigrams; document frequencies are counted over all documents. A bounded
sample of labelled texts gives the latent directions (truncated singular value decomposition) and the labelled vectors,
which are broadcast: their number and width are parameters, so the broadcast doesn't grow with the corpus. Every
document is projected and compared with all of them by exact cosine products, block by block; the labels of its nearest
are weighted by a power of the similarity and smoothed by the sample's prior.

Defined results: null, empty and one-byte texts have no trigram and score the prior; without usable labels the prior is
0.5; null labels and labels of unknown documents are not learnt from; a null id is never held out; repeated rows get
equal scores; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import text_groups, text_table


def trigram_counts(texts: list[str | None], width: int) -> np.ndarray:
    """Counts of hashed byte trigrams, one row for each text."""
    raw = [(t or "").encode() for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros((len(raw), width), np.float32)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    cell = ((code * np.uint32(2654435761)) >> np.uint32(12)) % np.uint32(width)
    owner = np.repeat(np.arange(len(raw)), lengths)
    inside = owner[:-2] == owner[2:]
    flat = np.bincount(owner[:-2][inside] * width + cell[inside], minlength=len(raw) * width)
    return flat.reshape(len(raw), width).astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit tf-idf rows with logarithmic counts."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def document_frequencies(texts: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """In how many of all texts each cell occurs, and the number of texts."""

    def run(batches):
        total, n = np.zeros(width, np.int64), 0
        for _, group in text_groups(batches):
            total += (trigram_counts(group, width) > 0).sum(0)
            n += len(group)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(width), -1), pa.int32()), pa.array(np.append(total, n), pa.int64())], ["cell", "n"])

    rows = {r["cell"]: r["n"] for r in texts.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    return np.array([rows.get(i, 0) for i in range(width)], np.float64), rows.get(-1, 0)


class NeighbourModel:
    """Latent directions and labelled unit vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, idf: np.ndarray, rank: int, nearest: int, sharpness: float):
        self.idf, self.nearest, self.sharpness = idf.astype(np.float32), nearest, sharpness
        x = weighted(counts, self.idf)
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.directions = vectors[:, np.argsort(values)[::-1][:rank]].astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.known = self.project(x)
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def project(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.directions
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        z = self.project(weighted(counts, self.idf))
        k = min(self.nearest, len(self.labels))
        for i in range(0, len(z), block):
            sims = z[i : i + block] @ self.known.T
            near = np.argpartition(sims, sims.shape[1] - k, axis=1)[:, -k:]
            w = np.maximum(np.take_along_axis(sims, near, 1), 0) ** self.sharpness
            out[i : i + block] = ((w * self.labels[near]).sum(1) + 0.05 * self.prior) / (w.sum(1) + 0.05)
        out[counts.sum(1) == 0] = self.prior
        return np.clip(out, 0, 1)


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    width: int = 1024,
    rank: int = 48,
    nearest: int = 15,
    sharpness: float = 8.0,
    per_class: int = 1500,
    folds: int = 5,
    threshold: float = 0.3,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1, that the label is 1), predicted.

    Labels of ids whose crc32 (of the id as text) is divisible by folds are held out. per_class: bound of the labelled
    rows of each label that are learnt from, the first by a hash of their id.
    """
    texts = text_table(docs, id_col, text_col)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    learnt = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold != 0)).distinct()
    picked = [learnt.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(per_class) for v in (0, 1)]
    frequencies, n = document_frequencies(texts, width)
    idf = np.log((1 + n) / (1 + frequencies)) + 0.1

    def count(batches):
        for batch, group in text_groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(trigram_counts(group, width)), pa.list_(pa.float32())), batch.column(2)], ["counts", "label"])

    # an id that stands in many rows, or has both labels, is learnt from once a label: by the text whose hash is smallest
    known = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = known.select("doc_id", "text", "label").mapInArrow(count, "counts array<float>, label int").toPandas()
    counts = np.stack(rows["counts"].to_list()) if len(rows) else np.zeros((0, width), np.float32)
    model = docs.sparkSession.sparkContext.broadcast(NeighbourModel(counts, rows["label"].to_numpy(np.float64), idf, rank, nearest, sharpness))

    def score(batches):
        for batch, group in text_groups(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(trigram_counts(group, width)), pa.float64())], ["doc_id", "score"])

    out = texts.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
