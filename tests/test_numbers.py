"""Lines and sentences that begin or end with digits keep them, at whatever place they stand; blanks go."""

import os

import __spark_entry__
import oracle
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X

TEXT = "Opening 10.\n1219538112535716 is of 4 words, and 121\n  2 blanks before and after 32  \n343\n404 last. 51 small. 2 words of the longest sentence that there is in this text of numbers, 313. 7!"
QUERIES = ["paragraphs", "sentences", "chapter_title", "chunk_paragraphs", "citation_labels", "claim_anchoring", "manifest_chunks", "page_of_offset", "excerpts", "full_context"]


@pytest.fixture(scope="module")
def numbered(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("numbered")
    for name in oracle.TABLES:
        if name != "documents":
            os.symlink(f"{sf}/{name}.parquet", d / f"{name}.parquet")
    rows = [(i, " ".join([f"{i}{i + 1}"] * i) + TEXT[i * 7:], "en", f"s{i % 3}", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.toPandas().to_parquet(d / "documents.parquet")
    return str(d)


def test_trimmed_of_blanks_only(spark):
    rows = spark.createDataFrame([(TEXT,)], "x string")
    assert rows.select(X.paragraphs(F.col("x"))).first()[0] == [line.strip(" ") for line in TEXT.split("\n")]


@pytest.mark.parametrize("name", QUERIES)
def test_numbers_stay(spark, numbered, name):
    assert oracle.compare(spark, name, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], numbered) == "ok"
