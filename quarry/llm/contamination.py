"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words (digits, lower-cased ASCII letters, non-ASCII characters). The windows of `n_words`
consecutive words of every item are the keys of an Aho-Corasick automaton over word numbers, which scans the words
of a document once; hit words are mapped back to character offsets of the original text.

The items are read from their table on the driver, which the automaton needs as a whole: their size is measured
first, and beyond `shard_bytes` they are split by hash of item_id and text into shards, each with an automaton and a scan of its own,
one after the other through the shared folder, so that neither driver nor executor holds more than a shard. The benchmark
of a run is one automaton and one scan up to 8 MiB of item texts.

Defined results: null and empty texts have no words; an item of fewer than n_words words, but not none, is one
window; texts and items of any length are whole; windows that overlap or tie count each word once; items with null item_id or no words find nothing; rows that repeat an item_id are one item with all their
windows; each document row gets its own result, also if doc_id is null or repeated; without items nothing is hit;
further columns stay, a column named found is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import byte_words, small_batches, table, without, written

#: Words in the original text, for offsets.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hits", T.ArrayType(T.IntegerType())),  # first and one past the last word of each run, flat
])

_compiled: dict = {}


class Windows:
    """The automaton of a shard: vocabulary, word-number keys, and the items behind each key."""

    def __init__(self, items: list[tuple[str, str]], n_words: int):
        import ahocorasick

        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set[str]] = {}
        for item, text in items:
            words = byte_words(text)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(ids) - n_words + 1) if ids else 0):
                owners.setdefault(tuple(ids[i:i + n_words]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, items_of in owners.items():
            self.automaton.add_word(key, (len(key), items_of))
        self.some = bool(owners)
        if self.some:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[int], set[str]]:
        """Number of words, runs of hit words, items."""
        words = byte_words(text)
        if not self.some or not words:
            return len(words), [], set()
        get = self.vocabulary.get
        runs: list[int] = []
        found: set[str] = set()
        spans = []
        for end, (size, items) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            spans.append((end - size + 1, end + 1))
            found |= items
        for start, end in sorted(spans):
            if runs and start <= runs[-1]:
                runs[-1] = max(runs[-1], end)
            else:
                runs += [start, end]
        return len(words), runs, found


def merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def offsets(text: str, runs: list[int]) -> list[tuple[int, int]]:
    """Runs of words as character spans of the original text."""
    if not runs:
        return []
    words = [m.span() for m in WORD.finditer(text)]
    return [(words[a][0], words[b - 1][1]) for a, b in zip(runs[::2], runs[1::2], strict=True)]


def _scanner(shared, n_words: int, text: str):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _compiled:
            _compiled.clear()
            _compiled[key] = Windows(shared.value, n_words)
        windows = _compiled[key]
        for batch in batches:
            texts, before = batch.column(batch.schema.get_field_index(text)), batch.column(batch.schema.get_field_index("__found"))
            rows = []
            for i in range(batch.num_rows):
                n, runs, items = windows.scan(texts[i].as_py())
                if (old := before[i].as_py()) is not None:
                    runs, items = merged(runs, old["hits"]), items | set(old["items"])
                rows.append({"n_words": n, "n_hit": sum(runs[1::2]) - sum(runs[::2]), "items": sorted(items), "hits": runs})
            k = batch.schema.get_field_index("__found")
            yield batch.set_column(k, batch.schema.field(k), pa.array(rows, batch.schema.field(k).type))

    return run


def contamination(docs: DataFrame, items: DataFrame, *, n_words: int = 10, text: str = "text", shard_bytes: int = 8 << 20) -> DataFrame:
    """docs and found: struct<n_words, n_hit, items (sorted as strings), hits (runs of hit words)>."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, "found")
    items = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    out = docs.withColumn("__found", F.lit(None).cast(FOUND))
    for k in range(shards):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        out = out.mapInArrow(_scanner(shared, n_words, text), out.schema)
        if k < shards - 1:
            out = written(out, "contamination")
    return out.withColumnRenamed("__found", "found")


def hit_spans(found: DataFrame, *, text: str = "text") -> DataFrame:
    """found (of contamination) and spans: array<struct<start,end>>, characters of the original text."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    @F.udf(kind, useArrow=True)
    def spans(t, hits):
        return [{"start": a, "end": b} for a, b in offsets(t, hits)] if hits else []

    return found.withColumn("spans", spans(F.col(text), F.col("found.hits")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op2_decontaminate": op2}
SQL = {
    "op2_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), keys AS (
  SELECT DISTINCT item_id, len(k) AS size, array_to_string(k, ' ') AS k FROM (
    SELECT item_id, w[i:i + 9] AS k FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0))
), spots AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, (SELECT DISTINCT size FROM keys) WHERE len(w) >= size)
), m AS (SELECT p.doc_id, p.i, p.size, keys.item_id FROM spots p JOIN keys ON p.k = keys.k AND p.size = keys.size
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON dw.doc_id = h.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
""",
}
