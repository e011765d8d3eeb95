"""Corpus operators: documents to paragraphs to overlapping chunks, manifests, neighbours, reading views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as X
from quarry.sources.stage import written


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_no, chunk_id, paragraph_start, paragraph_end (1-based, inclusive), text; docs: doc_id, text."""
    def each(ps: Column) -> Column:
        piece = lambda s: F.struct((s + 1).alias("first"), F.least(s + 4, F.size(ps)).alias("last"), F.array_join(F.slice(ps, s + 1, F.lit(4)), "\n\n").alias("text"))
        return F.transform(X.chunk_starts(ps), piece)

    # outer, since the filter that a plain explode implies would evaluate the chunks a second time
    rows = docs.select("doc_id", F.posexplode_outer(X.once(X.paragraphs(F.col("text")), each)).alias("i", "c")).filter("c is not null")
    return rows.select(
        "doc_id", (F.col("i") + 1).alias("chunk_no"), F.format_string("%s_%03d", F.col("doc_id").cast("string"), F.col("i") + 1).alias("chunk_id"),
        F.col("c.first").alias("paragraph_start"), F.col("c.last").alias("paragraph_end"), "c.text")


def running_title(rows: DataFrame) -> DataFrame:
    """The last heading detected so far in a document; rows: document, ordinal, heading (null where there is none)."""
    order = W.partitionBy("document").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("chapter_title", F.last("heading", ignorenulls=True).over(order))


def id_neighbours(chunk_ids: DataFrame) -> DataFrame:
    """Pairs (chunk_id, neighbour_id) by the three-digit number at the end of the id, where both exist."""
    number = F.regexp_extract("chunk_id", r"^(.*)_(\d{3})$", 2)
    stem = F.regexp_extract("chunk_id", r"^(.*)_(\d{3})$", 1)
    wanted = chunk_ids.filter(number != "").select("chunk_id", F.explode(F.array(number.cast("int") - 1, number.cast("int") + 1)).alias("k"), stem.alias("stem"))
    wanted = wanted.select("chunk_id", F.format_string("%s_%03d", "stem", "k").alias("neighbour_id"))
    return wanted.join(chunk_ids.select(F.col("chunk_id").alias("neighbour_id")), "neighbour_id").select("chunk_id", "neighbour_id")


def adjacency(rows: DataFrame) -> DataFrame:
    """Both directions of next-to-each-other within a document; rows: doc_id, chunk_no, chunk_id."""
    pairs = rows.withColumn("before", F.lag("chunk_id").over(W.partitionBy("doc_id").orderBy("chunk_no"))).filter("before is not null")
    return pairs.select("chunk_id", F.col("before").alias("neighbour_id")).union(pairs.select("before", "chunk_id"))


def merge_adjacent(ranges: DataFrame) -> DataFrame:
    """Chunks of a document and chapter whose ranges touch or overlap, as one; ranges: doc_id, chapter, start, end."""
    part = W.partitionBy("doc_id", "chapter").orderBy("start", "end")
    reach = F.max("end").over(part.rowsBetween(W.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("start") > reach + 1)).cast("int")
    return ranges.withColumn("new", new).withColumn("island", F.sum("new").over(part.rowsBetween(W.unboundedPreceding, 0))).groupBy("doc_id", "chapter", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("merged"))


def unseen_part(rows: DataFrame) -> DataFrame:
    """First paragraph of each chunk that the chunk before it didn't show already."""
    seen = F.lag("paragraph_end").over(W.partitionBy("doc_id").orderBy("chunk_no"))
    return rows.withColumn("shown_from", F.greatest("paragraph_start", F.coalesce(seen + 1, F.col("paragraph_start"))))


def manifest(rows: DataFrame) -> DataFrame:
    """chunk_id, document, paragraph range, text_sha256 and char_count of chunks."""
    return rows.select("chunk_id", "doc_id", "paragraph_start", "paragraph_end", F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("char_count"))


def split_index(rows: DataFrame, headings: tuple[str, ...] = ("index", "general index", "index of names"), share: float = 0.55) -> DataFrame:
    """Marks the paragraphs from the first index heading on that stands at or after `share` of its document."""
    part = W.partitionBy("doc_id")
    clean = F.trim(F.regexp_replace(F.lower("paragraph"), "[^a-z ]+", " "))
    late = F.col("pos") >= F.floor(F.count("*").over(part) * share)
    start = F.min(F.when(clean.isin(*headings) & late, F.col("pos"))).over(part)
    return rows.withColumn("in_index", F.coalesce(F.col("pos") >= start, F.lit(False)))


def candidate_terms(texts: DataFrame, limit: int) -> DataFrame:
    """Most frequent capitalised phrases; ties go to the one that is met first."""
    found = texts.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\b\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,3}"), 0)).alias("pos", "term")).filter("length(term) > 3")
    seen = found.groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return seen.orderBy(F.desc("n"), "first").limit(limit).select("term", "n")


def diff_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """chunk_id and status by key: missing, added, changed or unchanged."""
    a, b = old.select("chunk_id", F.col("text_sha256").alias("a")), new.select("chunk_id", F.col("text_sha256").alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return a.join(b, "chunk_id", "full").select("chunk_id", status.alias("status"))


def holding(chunks: DataFrame, needles: DataFrame, key: str) -> DataFrame:
    """Chunks (with the needle's key) whose text holds a needle as characters, whatever the case. needles: key, needle.

    A needle's word between two others has to stand in a text as a whole word: its longest such word finds the texts that
    are searched. Needles of one or two words are looked up on the words that hold their longest one. Needles without
    any letter or number find nothing. What meets the chunks is written before, so that its size is known: while it is small,
    neither the chunks' words nor their texts are dealt out.
    """
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), 0)
    longest = lambda ws: F.get(F.array_sort(ws, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), F.lit(0))
    n = needles.select(key, F.lower("needle").alias("needle"), words(F.col("needle")).alias("ws")).filter(F.size("ws") > 0)
    n = n.withColumn("whole", F.size("ws") > 2).withColumn("word", longest(F.when(F.col("whole"), F.slice("ws", 2, F.greatest(F.size("ws") - 2, F.lit(1)))).otherwise(F.col("ws")))).drop("ws")
    spots = chunks.select("chunk_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    part = n.filter(~F.col("whole")).withColumnRenamed("word", "piece")
    sizes = part.agg(F.collect_set(F.length("piece")).alias("sizes"))  # one row, a number for each length
    fit = F.filter("sizes", lambda k: k <= F.length("word"))
    cuts = F.array_distinct(F.flatten(F.transform(fit, lambda k: F.transform(F.sequence(F.lit(1), F.length("word") - k + 1), lambda i: F.substring("word", i, k)))))
    inside = spots.select("word").distinct().crossJoin(F.broadcast(sizes)).select("word", F.explode(cuts).alias("piece")).join(part, "piece")
    inside = written(inside, "inside")
    found = spots.join(n.filter("whole"), "word").select(key, "chunk_id", "needle").unionByName(spots.join(inside, "word").select(key, "chunk_id", "needle")).distinct()
    return written(found, "holding").join(chunks, "chunk_id").filter(F.contains(F.lower("text"), F.col("needle"))).drop("needle")
