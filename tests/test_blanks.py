"""Blanks of other kinds around and between lines, sentences and words, as the SQL takes them."""

import os

import __spark_entry__
import oracle
import pytest

LONG = "word " * 30
TEXTS = [
    " nbsp start\nline two　\n third  line \n " + LONG, "One.\u000bTwo!  Three? Four. Five　", "tab\t\n\tTab line\t\n#h\n[IMAGE]\n #not\n [IMAGE] \n" + LONG,
    f"{LONG}\n{LONG}\n{LONG}: \n　“quote {LONG}\n{LONG}", f"İndeed, x {LONG}\n{LONG}\n{LONG}\nİndeed, {LONG}\n{LONG}\n{LONG}", None, "", " \n　", "A.\u0085B. C. D",
    " ".join(f"w{i}\u000bv" for i in range(60)) + " the", " og .  m᠎",
]
QUERIES = [
    "chapter_title",
    "chunk_paragraphs",
    "citation_labels",
    "claim_anchoring",
    "manifest_chunks",
    "page_of_offset",
    "excerpts",
    "full_context",
]


@pytest.fixture(scope="module")
def blank(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("blank")
    for name in oracle.TABLES:
        if name != "documents":
            os.symlink(f"{sf}/{name}.parquet", d / f"{name}.parquet")
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.toPandas().to_parquet(d / "documents.parquet")
    return str(d)


@pytest.mark.parametrize("name", QUERIES)
def test_blanks_as_in_sql(spark, blank, name):
    assert oracle.compare(spark, name, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], blank) == "ok"
