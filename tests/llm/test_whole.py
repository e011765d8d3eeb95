"""Whole results: cases in which an operator or a stage once did less than its whole job."""

import random

import corpus_pipeline
from quarry.llm import lines, neardup


def runs_brute(docs, min_words=10):
    """Texts without all lines of runs of min_words words or more that begin earlier too, run by run."""
    seen, gone = set(), {d: set() for d, _ in docs}
    for d, t in sorted(docs):
        rows = [(i, s) for i, raw in enumerate((t or "").split("\n")) if (s := raw.strip(" \t\r\f\v"))]
        for a in range(len(rows)):
            for b in range(a + 1, len(rows) + 1):
                run = tuple(s for _, s in rows[a:b])
                if sum(len(s.split()) for s in run) >= min_words:
                    if run in seen:
                        gone[d] |= {i for i, _ in rows[a:b]}
                    seen.add(run)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def test_lines_extended_to_the_end_of_runs(spark):
    long = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"{long}\nend."), (2, f"{long}\nend."), (3, f"{long}\nother end."), (4, f"{long}\nother end.\nx"), (5, f"a\nb\n{long}\n\nend.\nc"), (6, f"a\nb\n{long}\nnew"), (7, None)]
    docs += [(8 + i, "\n".join(f"l{(i * j * j + j) % 5} w w"[: 2 + 2 * (j % 3)].strip() for j in range(14))) for i in range(8)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == runs_brute(docs)
    assert got[2] == "" and got[4] == "x" and got[5] == "a\nb\n\nc" and got[6] == "new"


def test_stage_links_from_080(spark, sf):
    rnd, rows, alike = random.Random(6), [], []
    for i in range(40):
        words = [f"w{rnd.randrange(10 ** 6)}" for _ in range(300)]
        # one run of n words replaced changes n + 4 of 296 shingles: similarity 0.825, 0.805 and, not linked, 0.794
        n = (24, 28, 30)[i % 3]
        other = words[:100] + [f"x{rnd.randrange(10 ** 6)}" for _ in range(n)] + words[100 + n:]
        a, b = (set(neardup.shingles(" ".join(w)).tolist()) for w in (words, other))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        alike.append(len(a & b) / len(a | b))
    assert all(0.80 <= x < 0.85 for i, x in enumerate(alike) if i % 3 < 2) and all(0.78 < x < 0.80 for x in alike[2::3])
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()}
    assert kept == {2 * i for i in range(40)} | {2 * i + 1 for i, x in enumerate(alike) if x < 0.80}
