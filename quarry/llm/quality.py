"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's features are hashed words and beginnings of words (present or not) and a few statistics of its whole text; one weight vector w
is shared by all grades and ordered thresholds split the score: P(grade <= k) = sigmoid(threshold_k - w.x). Grades
from the labels: 0 toxic, 1 low quality, 2 good. A document is kept if the tail probability P(grade = 2) is at least
`keep_at`; the expected grade ranks documents.

The model is fitted on the driver on a bounded sample: the `max_rows` (8,000) labelled documents with the smallest
hash of doc_id. Only their hashed features reach the driver, not their texts; all documents are scored on executors.

Defined results: texts of any length are read whole; of several texts of a labelled doc_id one, the smallest by its features,
is learned from; equal probabilities are kept or rejected alike; null and empty texts have no words and are scored by their statistics (all zero); labels with
several rows for a doc_id count once, with the lowest grade; labels without a grade (null) are ignored; without labels, or with one grade only,
nothing can be fitted: expected_grade and tail are null and every document is kept; each row gets its own result,
also if doc_id is null or repeated; further columns stay, those named like results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import WORD_BYTES, small_batches, table, without

BITS = 18
N_STATS = 9
GRADES = 3
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_MARKS = b"!\"#$%&*+/:;<=>?@[\\]^_`{|}~"
#: Beginnings of words, in bytes, that are features beside the words.
STEMS = (4, 6)
_hashes: dict[bytes, list[int]] = {}


def _hash(word: bytes) -> list[int]:
    """A word's feature and those of its beginnings."""
    if (h := _hashes.get(word)) is None:
        if len(_hashes) >= 300_000:
            _hashes.clear()
        parts = [word, *(b"%d:%b" % (n, word[:n]) for n in STEMS if len(word) >= n)]
        h = _hashes[word] = [zlib.crc32(p) & ((1 << BITS) - 1) for p in parts]
    return h


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed distinct words (int32) and statistics (float64)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.translate(WORD_BYTES).split()
    kinds = set(words)
    ids = np.array([h for w in kinds for h in _hash(w)], np.int32)
    size = max(1, len(data))
    share = lambda drop: (len(data) - len(data.translate(None, drop))) / size
    lines = [x for x in data.split(b"\n") if x]
    stats = [
        np.log1p(len(words)), share(_UPPER), share(_DIGITS), share(_MARKS), share(b"|"), share(b"!"),
        len(kinds) / max(1, len(words)), sum(map(len, words)) / max(1, len(words)) / 10, 1 - len(set(lines)) / max(1, len(lines)),
    ]
    return np.unique(ids), np.array(stats)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    words: np.ndarray
    stats: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cuts: np.ndarray

    def score(self, ids: np.ndarray, stats: np.ndarray) -> float:
        return float(self.words[ids].sum() + ((stats - self.mean) / self.scale) @ self.stats)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0 .. GRADES - 2."""
        return _sigmoid(scores[:, None] - self.cuts[None, :])


def cut_points(p: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the last GRADES - 1 parameters: the first, and logarithms of the gaps."""
    last = p[len(p) - (GRADES - 1):]
    return np.concatenate([last[:1], last[0] + np.cumsum(np.exp(last[1:]))])


def gradient(p: np.ndarray, flat: np.ndarray, row: np.ndarray, x: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean log likelihood and its gradient. p: weights of words, of statistics, then thresholds; document row[i] has word flat[i]."""
    n, k = len(grades), len(p) - x.shape[1] - (GRADES - 1)
    s = np.bincount(row, p[flat], n) + x @ p[k:k + x.shape[1]]
    edges = np.concatenate([[-np.inf], cut_points(p), [np.inf]])
    a = _sigmoid(np.clip(edges[grades + 1] - s, -40, 40))
    b = _sigmoid(np.clip(edges[grades] - s, -40, 40))
    ds = (a + b - 1) / n
    prob = np.maximum(a - b, 1e-9)
    up, down = a * (1 - a) / prob / n, -b * (1 - b) / prob / n
    dcut = np.array([up[grades == g].sum() + down[grades == g + 1].sum() for g in range(GRADES - 1)])
    gaps = [dcut[j:].sum() * np.exp(p[len(p) - GRADES + 1 + j]) for j in range(1, GRADES - 1)]
    return float(np.log(prob).mean()), np.concatenate([np.bincount(flat, ds[row], k), x.T @ ds, [dcut.sum()], gaps])


def fit(ids: list[np.ndarray], stats: np.ndarray, grades: np.ndarray, *, rounds: int = 300, rate: float = 0.2, ridge: float = 3e-4, least_docs: int = 5) -> Ordinal:
    """Full-batch Adam, its rate falling to zero, on the mean log likelihood; words of fewer than least_docs sample documents get no weight."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    often = np.bincount(flat, minlength=1 << BITS) >= least_docs
    flat, row = flat[often[flat]], row[often[flat]]
    used, flat = np.unique(flat, return_inverse=True)
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    x, k = (stats - mean) / scale, len(used)
    # cuts start at the grades' own log odds
    below = np.clip([(grades <= g).mean() for g in range(GRADES - 1)], 1e-3, 1 - 1e-3)
    first = np.log(below / (1 - below))
    p = np.concatenate([np.zeros(k + x.shape[1]), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        _, g = gradient(p, flat, row, x, grades)
        g[:k] -= ridge * p[:k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p += rate * (1 - (t - 1) / rounds) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    words = np.zeros(1 << BITS, np.float32)
    words[used] = p[:k]
    return Ordinal(words, p[k:k + x.shape[1]], mean, scale, cut_points(p))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and its grade, from quality 0/1 and toxic 0/1."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.cast("int").alias("grade")).filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["doc_id", "grade", "ids", "stats"])


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 8000, text: str = "text") -> Ordinal | None:
    small_batches(docs.sparkSession)
    sample = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t")).join(F.broadcast(sample), "doc_id").select("doc_id", "t", "grade")
    # one text for each labelled document, so that at most max_rows rows come back
    one = joined.mapInArrow(_featured, "doc_id long, grade int, ids binary, stats binary").groupBy("doc_id").agg(F.min(F.struct("ids", "stats", "grade")).alias("r"))
    rows = one.select("r.*").collect()
    rows = sorted((bytes(r.ids), bytes(r.stats), r.grade) for r in rows)  # an order of their own
    grades = np.array([g for *_, g in rows], int)
    if len(set(grades.tolist())) < 2:
        return None
    return fit([np.frombuffer(i, np.int32) for i, *_ in rows], np.array([np.frombuffer(s) for _, s, _ in rows]), grades)


def _scoring(shared, text: str, keep_at: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            scores = np.array([model.score(*features(t)) for t in texts], float)
            tails = model.tails(scores)
            new = [pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "expected_grade", "tail", "kept"])

    return run


def classify(docs: DataFrame, model: Ordinal | None, *, keep_at: float = 0.5, text: str = "text") -> DataFrame:
    """docs and expected_grade, tail (double), kept (boolean)."""
    docs = without(docs, "expected_grade", "tail", "kept")
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "tail": F.lit(None).cast("double"), "kept": F.lit(True)})
    spark = docs.sparkSession
    small_batches(spark)
    schema = T.StructType([*docs.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return docs.mapInArrow(_scoring(spark.sparkContext.broadcast(model), text, keep_at), schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail", 6).alias("tail"), "kept")


QUERIES = {"op9_quality": op9}
SQL: dict[str, str] = {}
