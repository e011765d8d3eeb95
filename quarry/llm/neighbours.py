"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Vectors that are equal are searched once: a class keeps its k + 1 smallest ids, more can't be among anyone's k nearest.
An index holds coarse centroids (k-means) and codebooks of residuals (k-means in each of `parts` sub-spaces), fitted on
the driver on a bounded sample: the `max_sample` (16,384) classes with the smallest hash. Every class is indexed: nearest
centroid, and one byte for each part. A query visits lists in order of centroid distance; asymmetric distance tables
(query residual against codebooks) rank the codes of a list; those farther than the query's nearest in the sample are
passed over, and the `rerank` best of all its lists are measured in double precision on the original vectors. How many lists a query visits is calibrated on held-out sample queries
against brute force in the sample, so that recall reaches `recall` (0.97) there; data without cluster structure
needs a large share of the lists.

Lists are cut into blocks of bounded size and a query meets each block of its lists in a task of its own, which returns its
`rerank` best codes; so a list that holds a third of all rows is many tasks.

A query that the lists visited leave with fewer than k rows visits all lists, without passing over any code.

Defined results: equal distances rank by id; vectors of any dimension are whole; of codes alike at the `rerank`-th place any may
be left out; vectors that are null, zero, or hold null, NaN or infinite components take no part, nor do those of
another dimension than the sample's most frequent one; rows with null id take no part; rows that repeat an id and its vector are one;
with different vectors each of them is searched, and none is a candidate of its own id; fewer than k candidates
give as many rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.llm.common import table, written


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        filled = np.flatnonzero(count)
        centres[filled] = np.add.reduceat(x[order], (np.cumsum(count) - count)[filled], axis=0) / count[filled, None]
        empty = np.flatnonzero(count == 0)
        if len(empty):
            centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i:i + 8192], centres).argmin(1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


@dataclass
class Index:
    """Centroids, codebooks (parts x codes x width), how many lists and codes a query looks at, and the sample with
    what codes may overrate its distances by."""

    centres: np.ndarray
    books: np.ndarray
    probes: int
    rerank: int
    sample: np.ndarray
    slack: float

    def limits(self, q: np.ndarray, k: int) -> np.ndarray:
        """Squared distance beyond which a code can't be among a query's k nearest: the k + 1 nearest of the sample are
        nearer (one may be the query itself), by as much as codes err."""
        if len(self.sample) <= k:
            return np.full(len(q), np.inf)
        far = [np.partition(squared(q[i:i + 512], self.sample), k, axis=1)[:, k] for i in range(0, len(q), 512)]
        return np.maximum(np.concatenate(far), 0) + self.slack

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        rest = np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], axis=1)
        return self.centres[lists] + rest

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest(x, self.centres)
        rest = (x - self.centres[lists]).reshape(len(x), len(self.books), -1)
        codes = np.stack([nearest(rest[:, p], b) for p, b in enumerate(self.books)], 1)
        return lists, codes.astype(np.uint8)

    def visited(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(squared(q, self.centres), axis=1, kind="stable")[:, :self.probes]

    def tables(self, q: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """queries x parts x codes: squared distance of a query's residual to each code."""
        rest = (q - centre).reshape(len(q), len(self.books), -1)
        return np.stack([squared(rest[:, p], b) for p, b in enumerate(self.books)], 1)


def fit(x: np.ndarray, n_rows: int, *, k: int, parts: int = 16, codes: int = 256, recall: float = 0.97, seed: int = 3) -> Index:
    """x: sample of classes in hash order; n_rows: how many the index will hold."""
    x = x.astype(np.float64)
    dim = x.shape[1]
    parts = next(p for p in range(min(parts, dim), 0, -1) if dim % p == 0)
    lists = int(np.clip(np.sqrt(n_rows) / 2, 1, min(1024, max(1, len(x) // 16))))
    centres = k_means(x, lists, 12, seed)
    rest = (x - centres[nearest(x, centres)]).reshape(len(x), parts, -1)
    books = np.stack([_filled(k_means(rest[:, p], codes, 8, seed + p), codes) for p in range(parts)])
    index = Index(centres, books, len(centres), 40 * k, x.astype(np.float32), 0.0)
    # calibration: which lists hold the true neighbours of 256 sample queries
    q = np.arange(min(256, len(x)))
    near = squared(x[q], x)
    near[q, q] = np.inf
    true = np.argsort(near, axis=1)[:, :min(k, max(1, len(x) - 1))]
    of, seen = index.encode(x)
    error = ((x[q][:, None] - index.decoded(of, seen)[true]) ** 2).sum(2) - np.take_along_axis(near, true, 1)
    index.slack = 1.5 * max(0.0, float(np.quantile(error, 0.995))) if error.size else 0.0
    rank = np.argsort(np.argsort(squared(x[q], centres), axis=1, kind="stable"), axis=1)
    needed = np.sort(rank[q[:, None], of[true]].ravel())
    index.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else 1
    return index


def _filled(centres: np.ndarray, codes: int) -> np.ndarray:
    """Small samples have fewer centres than codes; those beyond are far off."""
    return np.concatenate([centres, np.full((codes - len(centres), centres.shape[1]), 1e6)])


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _encoder(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if batch.num_rows:
                lists, codes = index.encode(_matrix(batch.column(batch.schema.get_field_index("v")), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], [*batch.schema.names, "list", "code"])

    return run


def _router(shared, dim: int, k: int, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if batch.num_rows:
                q = _matrix(batch.column(1), dim)
                most = np.full(len(q), np.inf) if every else index.limits(q, k)
                lists = [list(range(len(index.centres)))] * len(q) if every else index.visited(q).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(most), pa.array(lists, pa.list_(pa.int32()))], ["query_id", "q", "most", "lists"])

    return run


def _searcher(shared, dim: int):
    def run(key, group):
        """Queries (code null) and codes of one block of a list: the best codes of each query by table look-ups."""
        index = shared.value
        is_code = group.column("code").is_valid()
        codes, asked = group.filter(is_code), group.filter(pa.compute.invert(is_code))
        out_q, out_c, out_d = [], [], []
        if codes.num_rows and asked.num_rows:
            c = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(codes.num_rows, -1)
            ids, queries, most = codes.column("class").to_numpy(), asked.column("query_id").to_numpy(), asked.column("most").to_numpy()
            q = _matrix(asked.column("q"), dim)
            lut = index.tables(q, index.centres[key[0].as_py()])
            for i in range(len(q)):
                d = lut[i, 0].take(c[:, 0])
                for p in range(1, c.shape[1]):
                    d = d + lut[i, p].take(c[:, p])
                best = np.flatnonzero(d <= most[i])
                if len(best) > index.rerank:
                    best = best[np.argpartition(d[best], index.rerank - 1)[:index.rerank]]
                out_q.append(np.full(len(best), queries[i]))
                out_c.append(ids[best])
                out_d.append(d[best])
        join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table({"query_id": join(out_q, pa.int64()), "class": join(out_c, pa.int64()), "near": join(out_d, pa.float64())})

    return run


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 10, max_sample: int = 16_384, block_rows: int = 4096, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found. vectors, queries: vec_id, embedding (array of numbers)."""
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    rows = lambda df: df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    # a class for each vector; ids beyond the k + 1 smallest can't be among the k nearest of any query
    place = F.dense_rank().over(W.partitionBy("v").orderBy("id"))
    named = rows(vectors).withColumn("r", place).filter(F.col("r") <= k + 1)
    classes = named.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    classes = written(classes.withColumn("class", F.col("ids")[0]), "vectors")
    sample = classes.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(max_sample).collect()
    if not sample:
        return spark.createDataFrame([], shape)
    dim = Counter(len(r.v) for r in sample).most_common(1)[0][0]
    classes = classes.filter(F.size("v") == dim)
    index = fit(np.array([r.v for r in sample if len(r.v) == dim]), classes.count(), k=k, recall=recall)
    shared = spark.sparkContext.broadcast(index)
    coded = classes.select("class", "v").mapInArrow(_encoder(shared, dim), "class long, v array<double>, list int, code binary")
    coded = written(coded.select("class", "list", "code"), "codes")
    blocks = coded.groupBy("list").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    dealt = coded.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    asked = rows(queries).filter(F.size("v") == dim).select(F.col("id").alias("query_id"), F.col("v").alias("q")).distinct()
    none = {"class": F.lit(None).cast("long"), "code": F.lit(None).cast("binary")}
    answers = dealt.select("list", "block", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("q"), F.lit(None).cast("double").alias("most"), "class", "code")

    def found(asked: DataFrame, every: bool) -> DataFrame:
        routed = asked.mapInArrow(_router(shared, dim, k, every), "query_id long, q array<double>, most double, lists array<int>").select("query_id", "q", "most", F.explode("lists").alias("list"))
        routed = routed.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        questions = routed.select("list", "block", "query_id", "q", "most").withColumns(none)
        near = questions.unionByName(answers).groupBy("list", "block").applyInArrow(_searcher(shared, dim), "query_id long, class long, near double")
        best = W.partitionBy("query_id").orderBy("near", "class")
        near = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= index.rerank).select("query_id", "class")
        # exact measure on the original vectors, in double precision
        measured = near.join(classes, "class").join(asked, "query_id")
        gap = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        rows = measured.select("query_id", gap.alias("score"), F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
        rows = rows.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        last = W.partitionBy("query_id").orderBy("score", "vec_id")
        return rows.withColumn("rank", F.row_number().over(last).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = written(found(asked, False), "nearest")
    # queries left with fewer than k rows visit all lists without a limit
    short = asked.join(first.filter(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    short = written(short, "short-queries")
    if short.isEmpty():
        return first
    return first.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(found(short, True))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))


QUERIES = {"op1_nearest": op1}
SQL: dict[str, str] = {}
