"""Line dedup by winnowing. DataFrame operations only.

A document is the sequence of its lines that are not blank, trimmed. A run is a stretch of such lines with at least
`min_words` words; it is repeated if it also begins at an earlier place: in a smaller doc_id, or before it in the same
document. Exactly the lines of all repeated runs are deleted.

1. Winnowing. From each line a window runs over the fewest lines that have `min_words` words, and selects its line of
   smallest hash as fingerprint. Whatever run two places share holds a whole window, so both select the same
   fingerprint in it. Neighbouring windows mostly select the same line: one row leaves for each selected line.
2. Positions of equal fingerprints are joined: fingerprints at one place only are discarded.
3. Matches are extended both ways from the fingerprints that are left: to the left by the windows that begin before
   it and hold it, to the right line by line while what follows the window's first line has less than `min_words`
   words. Each stretch is compared by two hashes of its lines, with its earliest place, not pair by pair.
4. What also begins earlier is deleted. These stretches cover all repeated runs: a line of one lies in a window of it,
   or, where less than `min_words` words of the run follow the last window's first line, behind that window.

Defined results: null text stays null and has no lines; blank lines stay; documents with null doc_id come first in the
order; rows with the same doc_id and the same text count as one place, so they get the same lines deleted; rows with
the same doc_id and different texts are ordered by a hash of the text; equal places can't tie otherwise; a text of any
length is one row, its work grows with its lines; an empty table gives an empty result; further columns stay, those
named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import once
from quarry.llm.common import table, without, written

#: What lines are trimmed of and words are separated by (beside the newline).
BLANKS = " \t\r\f\u000b"


def line_hashes(text: Column) -> Column:
    """array<struct<pos, a, b, w>>: place, two hashes and number of words of each line that is not blank."""
    trimmed = F.transform(F.split(text, "\n"), lambda s, i: F.struct(i.alias("pos"), F.trim(s, F.lit(BLANKS)).alias("l")))
    words = lambda x: F.regexp_count(x.l, F.lit(r"[^ \t\r\f\x0b]+"))
    return F.transform(F.filter(trimmed, lambda x: x.l != ""), lambda x: F.struct(
        x.pos.alias("pos"), F.xxhash64(x.l).alias("a"), F.xxhash64(F.lit(1), x.l).alias("b"), words(x).alias("w")))


def windows(lines: Column, min_words: int) -> Column:
    """array<struct<n, m, fp>> by first line: lines of the window (0: the document ends before), lines up to where those
    behind the first have min_words words, and the fingerprint (hash, place)."""
    zero = F.struct(*(F.lit(0).alias(x) for x in ("k", "w", "first", "n", "m")))

    def step(s: Column, x: Column) -> Column:
        k, w = s.k + 1, s.w + x.w
        first = F.when(s.k == 0, x.w).otherwise(s["first"])
        return F.struct(
            k.alias("k"), w.alias("w"), first.alias("first"),
            F.when((s.n == 0) & (w >= min_words), k).otherwise(s.n).alias("n"),
            F.when((s.k == 0) | (w - first < min_words), k).otherwise(s.m).alias("m"),
        )

    def window(x: Column, i: Column) -> Column:
        size = F.aggregate(F.slice(lines, i + 1, F.lit(min_words)), zero, step)
        least = lambda v: F.array_min(F.transform(F.slice(lines, i + 1, v.n), lambda y: F.struct(y.a.alias("a"), y.pos.alias("pos"))))
        return once(size, lambda v: F.struct(v.n.alias("n"), v.m.alias("m"), least(v).alias("fp")))

    return F.transform(lines, window)


def fingerprints(text: Column, min_words: int) -> Column:
    """array<struct<fp, matches array<struct<p, runs array<struct<q, ra, rb>>>>>>: each selected line once, with the
    stretches of lines p..q around it and their hashes."""

    def stretches(lines: Column, s: Column, v: Column) -> Column:
        def run(k: Column) -> Column:
            part = F.slice(lines, s + 1, k)
            return F.struct(F.get(lines, s + k - 1).pos.alias("q"), F.xxhash64(F.transform(part, lambda x: x.a)).alias("ra"), F.xxhash64(F.transform(part, lambda x: x.b)).alias("rb"))

        return F.struct(F.get(lines, s).pos.alias("p"), F.transform(F.sequence(v.n, F.greatest(v.n, v.m)), run).alias("runs"))

    def selected(lines: Column, wins: Column) -> Column:
        def group(w: Column, i: Column) -> Column:
            # windows that hold a line begin at most min_words - 1 lines before it, one after the other
            near = F.transform(F.slice(wins, i + 1, F.lit(min_words)), lambda v, j: F.struct((i + j).alias("s"), v.n.alias("n"), v.m.alias("m"), v.fp.alias("fp")))
            same = F.filter(near, lambda v: v.fp == w.fp)
            new = w.fp.isNotNull() & ((i == 0) | ~F.get(wins, i - 1).fp.eqNullSafe(w.fp))
            return F.when(new, F.struct(w.fp.a.alias("fp"), F.transform(same, lambda v: stretches(lines, v.s, v)).alias("matches")))

        return F.filter(F.transform(wins, group), lambda x: x.isNotNull())

    return once(line_hashes(text), lambda lines: once(windows(lines, min_words), lambda wins: selected(lines, wins)))


def repeated_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(__d, __h, gone array<int>): places between which no line but a blank one stays; docs: __d, __h, __t."""
    marks = docs.select("__d", "__h", F.explode(fingerprints(F.col("__t"), min_words)).alias("x")).select("__d", "__h", "x.fp", "x.matches")
    marks = written(marks, "fingerprints")
    # a fingerprint at one place only cannot lie in a repeated run
    shared = marks.groupBy("fp").count().filter("count > 1").select("fp")
    matches = marks.join(shared, "fp", "left_semi").select("__d", "__h", F.explode("matches").alias("m"))
    runs = matches.select("__d", "__h", F.col("m.p").alias("p"), F.explode("m.runs").alias("r"))
    runs = runs.select(F.struct("__d", "__h", "p").alias("at"), "r.q", "r.ra", "r.rb")
    first = runs.groupBy("ra", "rb").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last").select("ra", "rb", "first")
    later = runs.join(first, ["ra", "rb"]).filter("at > first")
    # of the stretches from one line the longest holds the others
    longest = later.groupBy("at").agg(F.max("q").alias("q"))
    gone = longest.select("at.__d", "at.__h", F.explode(F.sequence("at.p", "q")).alias("line"))
    return gone.groupBy("__d", "__h").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, *, min_words: int = 10, text: str = "text") -> DataFrame:
    """docs with text without its later repeated runs of lines, and n_lines, n_lines_removed (long)."""
    docs = without(docs, "n_lines", "n_lines_removed")
    keep = docs.columns
    base = docs.withColumns({"__d": F.col("doc_id"), "__h": F.xxhash64(text), "__t": F.col(text)})
    gone = repeated_lines(base.filter("__t is not null").select("__d", "__h", "__t"), min_words)
    gone = gone.withColumnsRenamed({"__d": "__gd", "__h": "__gh", "gone": "__gone"}).hint("shuffle_hash")
    both = base.join(gone, F.col("__d").eqNullSafe(F.col("__gd")) & (F.col("__h") == F.col("__gh")), "left")

    def kept(parts: Column) -> Column:
        places = F.transform(parts, lambda s, i: F.when(F.trim(s, F.lit(BLANKS)) == "", i))
        blank = F.filter(places, lambda i: i.isNotNull())
        rest = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
        return F.transform(F.array_sort(F.array_union(rest, blank)), lambda i: F.get(parts, i))

    count = F.coalesce(F.length("__t") - F.length(F.replace("__t", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    both = both.withColumns({"__n": count, "__left": F.when(F.col("__gone").isNotNull(), once(F.split("__t", "\n"), kept))})
    clean = F.when(F.col("__left").isNull(), F.col("__t")).otherwise(F.array_join("__left", "\n"))
    removed = F.when(F.col("__left").isNull(), F.lit(0)).otherwise(F.col("__n") - F.size("__left")).cast("long")
    out = both.withColumns({"__clean": clean, "__g": removed})
    return out.select(*[F.col("__clean").alias(c) if c == text else F.col(c) for c in keep], F.col("__n").alias("n_lines"), F.col("__g").alias("n_lines_removed"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op10_line_dedup": op10}
#: All runs of at most ten lines with ten words or more (each line of a longer one lies in such a run of it).
SQL = {
    "op10_line_dedup": r"""
WITH l AS (
  SELECT doc_id, pos, raw, trim(raw, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) AS s
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), n AS (
  SELECT doc_id, pos, s, len(regexp_extract_all(s, '[^ \t\r\f\v]+')) AS w FROM l WHERE s <> ''
), f AS (
  SELECT doc_id, pos, list({'pos': pos, 's': s, 'w': w}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS f FROM n
), runs AS (
  SELECT doc_id, pos, f[1:k] AS lines FROM (SELECT doc_id, pos, f, unnest(range(1, len(f) + 1)) AS k FROM f)
  WHERE list_sum(list_transform(f[1:k], lambda x: x.w)) >= 10
), named AS (
  SELECT doc_id, pos, list_transform(lines, lambda x: x.pos) AS places, md5(array_to_string(list_transform(lines, lambda x: x.s), chr(10))) AS body FROM runs
), later AS (
  SELECT doc_id, places FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS rn FROM named) WHERE rn > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(places) AS pos FROM later
)
SELECT d.doc_id, CAST(coalesce(max(k.n), 0) AS BIGINT) AS n_lines, CAST(coalesce(max(k.g), 0) AS BIGINT) AS n_lines_removed,
       sha256(coalesce(max(k.t), '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT l.doc_id, count(*) AS n, count(gone.pos) AS g, string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL) AS t
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id
) k ON d.doc_id = k.doc_id
GROUP BY d.doc_id
""",
}
