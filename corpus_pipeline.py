"""From raw documents to a training mix. Counts as part of quarry.llm.

Each stage gets what the one before kept, as written and read again; all but the last return the columns of
documents, whatever further columns there are and however they are named (only doc_id, text and source are used; n_chars
follows a text that got shorter, where there is such a column). Nulls: a null or empty text passes the classifier's
decision on its statistics, has no lines, is linked with nothing, is hit by no benchmark item, and is not drawn by the
mix, since it has no words. Rows that repeat a doc_id are judged each by its own text; near copies keep or drop all rows
of a doc_id. Very long texts are whole everywhere; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, written
from quarry.llm.contamination import contamination
from quarry.llm.lines import dedup_lines
from quarry.llm.mixing import mix
from quarry.llm.neardup import near_duplicates
from quarry.llm.quality import classify, train

USED = ("doc_id", "text", "source")


def shielded(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of docs after stage, which sees those it doesn't use under names that no operator has."""
    names = [c if c in USED else f"column_{i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rating is good with a probability of at least one half."""
    return shielded(docs, lambda d: classify(d, train(d, table(spark, sf_dir, "labels"))).filter("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; a document of which nothing is left goes."""
    counted = {f"column_{i}": F.when(F.col("n_lines_removed") > 0, F.length("text")).otherwise(F.col(f"column_{i}")).cast(docs.schema[c].dataType)
               for i, c in enumerate(docs.columns) if c == "n_chars"}

    def stage(d: DataFrame) -> DataFrame:
        return dedup_lines(d).filter("n_lines_removed = 0 or trim(translate(text, '\n\r\t\f\x0b', '     ')) <> ''").withColumns(counted)

    return shielded(docs, stage)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies: similarity 0.80, where 0.85 is op7's own."""
    gone = near_duplicates(docs.select("doc_id", "text"), percent=80, estimate_from=0.65).filter("not kept").select("doc_id").distinct()
    return shielded(docs, lambda d: d.join(gone.hint("shuffle_hash"), "doc_id", "left_anti"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return shielded(docs, lambda d: contamination(d, table(spark, sf_dir, "benchmark")).filter("found.n_hit = 0"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws of the sources to temperature weights."""
    return mix(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mix", mixed)]

#: The fitted classifier has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
