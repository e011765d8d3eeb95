"""Near duplicates by SetSketch registers.

A document is the set of its distinct five-word shingles, as 64-bit hashes. Its sketch has 150 registers: of the
exponentially spread hashes of the shingles (rate A) the smallest for each register, truncated to the integer
floor(1 - log_B(smallest)) in 0 .. 65535; the sketch of a union is the maximum of the sketches. Steps:

1. documents with the same set form a class; its smallest doc_id stands for it;
2. registers are cut into 30 bands of 5; classes that share a band belong to one cluster, transitively (each band's
   members are linked to its smallest, so the number of links is that of the members). Two sets of similarity 0.85
   share no band with probability (1 - 0.85**5)**30 = 2e-8;
3. all pairs of a cluster are met in blocks of bounded bytes: the joint likelihood of two register sets gives an
   estimate of the similarity; pairs above `estimate_from` that are not yet linked in the block are verified on the
   full sets, and a verified pair is a link. Large clusters are dealt over pairs of blocks, so that nothing unbounded
   meets in one task and no pair is left out;
4. components of the links; the smallest doc_id of each names it.

Defined results: null texts and texts without words are empty and linked with nothing; fewer than five words are one
shingle; rows with null doc_id get their sizes and no component_id, are kept and linked with nothing; rows that repeat a doc_id
are one document, linked by any of its texts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, table, written
from quarry.llm.graph import components

BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
A, B, TOP = 20.0, 1.001, 65535
_rng = np.random.default_rng(7)
_TIMES = _rng.integers(0, 1 << 63, REGISTERS, np.uint64) << np.uint64(1) | np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _word(w: bytes) -> int:
    if (h := _words.get(w)) is None:
        if len(_words) >= 500_000:
            _words.clear()
        h = _words[w] = xxhash.xxh3_64_intdigest(w)
    return h


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(min(len(h), size)))
    for k in range(min(len(h), size)):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set that is not empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at:at + 2048, None] * _TIMES[None, :] + _PLUS[None, :]).min(0))
    u = (least.astype(np.float64) + 0.5) / 2.0 ** 64
    spread = -np.log1p(-np.minimum(u, 1 - 1e-16)) / A
    return np.clip(np.floor(1 - np.log(spread) / np.log(B)), 0, TOP).astype(np.uint16)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, d1, d2, regs = [], [], [], []
        for t in batch.column(1).to_pylist():
            s = shingles(t)
            n.append(len(s))
            d1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
            d2.append(int(np.bitwise_xor.reduce(_mix(s * np.uint64(3) + np.uint64(1)), initial=np.uint64(0)).view(np.int64)))
            regs.append(sketch(s).astype(">u2").tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "regs"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digests of the set), regs; docs: doc_id, text."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_sketched, "doc_id long, n_shingles long, d1 long, d2 long, regs binary")


def estimates(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest similarity of sets of n_a and n_b elements from how many registers of a are larger or smaller.

    A register of a is larger with probability -log_B(1 - x (B - 1) / B), x = u - v j, u and v being the shares of the
    sizes; likewise the other way; the likelihood is maximised over j.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)
    equal = REGISTERS - more - less
    scale, base = (B - 1) / B, np.log(B)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p = np.maximum(-np.log1p(-np.maximum(u - v * j, 1e-12) * scale) / base, 1e-12)
        q = np.maximum(-np.log1p(-np.maximum(v - u * j, 1e-12) * scale) / base, 1e-12)
        return more * np.log(p) + less * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros_like(top), top.copy()
    ratio = (5 ** 0.5 - 1) / 2
    for _ in range(22):  # golden section: the likelihood has one peak
        x, y = high - ratio * (high - low), low + ratio * (high - low)
        left = likelihood(x) > likelihood(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def block_links(ids: list[int], regs: np.ndarray, sets: list[bytes], part: np.ndarray, percent: int, estimate_from: float) -> list[tuple[int, int]]:
    """Spanning links between rows of a block: within one part, or between two different parts."""
    n = len(ids)
    two = len(set(part.tolist())) > 1
    sizes = np.array([len(s) // 8 for s in sets], float)
    own: dict[int, frozenset] = {}

    def members(i: int) -> frozenset:
        if i not in own:
            if len(own) > 4096:
                own.clear()
            own[i] = frozenset(np.frombuffer(sets[i], np.uint64).tolist())
        return own[i]

    found, groups = [], Union(n)
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        if two:
            rest = rest[part[i + 1:] != part[i]]
        rest = rest[np.minimum(sizes[i], sizes[rest]) * 100 >= percent * np.maximum(sizes[i], sizes[rest])]
        if not len(rest):
            continue
        # registers alike in at least this share can be similar enough; a cheap bound before the likelihood
        same = (regs[rest] == regs[i]).sum(1)
        rest = rest[same >= REGISTERS * (estimate_from - 0.1)]
        if not len(rest):
            continue
        more, less = (regs[i] > regs[rest]).sum(1), (regs[i] < regs[rest]).sum(1)
        close = estimates(more, less, np.full(len(rest), sizes[i]), sizes[rest])
        for k in np.argsort(-close, kind="stable"):
            if close[k] < estimate_from:
                break
            j = int(rest[k])
            if groups.find(i) == groups.find(j):
                continue
            both = len(members(i) & members(j))
            if 100 * both >= percent * (int(sizes[i]) + int(sizes[j]) - both):
                found.append((ids[i], ids[j]))
                groups.join(i, j)
    return found


def _linker(percent: int, estimate_from: float):
    def run(key, group):
        regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), ">u2").reshape(-1, REGISTERS).astype(np.uint16)
        links = block_links(group.column("rep").to_pylist(), regs, group.column("shingles").to_pylist(), group.column("part").to_numpy(), percent, estimate_from)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        digests = batch.column(batch.schema.get_field_index("d1")).to_pylist()
        # a doc_id with several texts meets the classes of all of them; each class gets its own set
        own = pa.array([int(s.sum(dtype=np.uint64).view(np.int64)) == d for s, d in zip(sets, digests, strict=True)], pa.bool_())
        rest = [i for i, x in enumerate(batch.schema.names) if x != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array([s.tobytes() for s in sets], pa.binary())], [*(batch.schema.names[i] for i in rest), "shingles"]).filter(own)


def near_duplicates(docs: DataFrame, *, percent: int = 85, estimate_from: float = 0.72, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text). Links: 100 * both >= percent * either."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = written(sketches(docs), "sketches")
    known = sig.filter("doc_id is not null and n_shingles > 0")
    reps = known.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "regs")).alias("r"))
    reps = written(reps.select("d1", "d2", "n_shingles", F.col("r.doc_id").alias("rep"), "r.regs"), "classes")
    bands = reps.select("rep", F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])).alias("band"))
    hubs = bands.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").select("band", "hub")
    star = bands.join(hubs, "band").filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = components(star)
    # members with their registers; large clusters in parts of bounded bytes
    members = reps.join(clusters, reps.rep == clusters.node).select("d1", "d2", "rep", "regs", "n_shingles", F.col("label").alias("cluster"))
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum(F.col("n_shingles") * 8 + 2 * REGISTERS) / F.lit(block_bytes)).cast("int").alias("parts"))
    members = members.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("rep", "d1"), F.col("parts")).cast("int"))
    members = written(members.select("d1", "rep", "regs", "cluster", "parts", "part"), "members")
    texts = docs.join(members.hint("shuffle_hash"), docs.doc_id == members.rep).drop("doc_id")
    kind = "text string, d1 long, rep long, regs binary, cluster long, parts int, part int"
    sets = texts.select([F.col(x.split()[0]) for x in kind.split(", ")]).mapInArrow(_with_sets, kind.replace("text string, ", "") + ", shingles binary")
    mates = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("mate")
    dealt = sets.select("rep", "regs", "cluster", "part", "shingles", mates).select("rep", "regs", "cluster", "part", "shingles", F.least("part", "mate").alias("i"), F.greatest("part", "mate").alias("j"))
    links = dealt.groupBy("cluster", "i", "j").applyInArrow(_linker(percent, estimate_from), "a long, b long")
    labels = components(written(links, "near-links"))
    by_class = reps.join(labels, reps.rep == labels.node, "left").select("d1", "d2", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "d1", "d2").join(by_class.hint("shuffle_hash"), ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_near_duplicates": op7}
SQL = {
    "op7_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS label FROM n UNION SELECT e.b, r.label FROM reach r JOIN both_ways e ON e.a = r.node
), c AS (SELECT node, min(label) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
""",
}
