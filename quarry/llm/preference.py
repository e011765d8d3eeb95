"""Preference formatting of conversation pairs. DataFrame operations only.

A pair names a chosen and a rejected conversation. Their longest common turn prefix (same role and same text, turn
by turn) is rendered once as the prompt; what follows in either becomes its completion, and mask spans name the
characters of a completion that count for the loss: the text and end mark of its assistant turns.

A turn is rendered as `<|role|>\n` + text + `<|end|>\n`. Turns are ordered by turn (null first), then role and text,
so rows that repeat a turn are turns of their own next to each other, in a defined order.

Defined results: null role or text is rendered as the empty string but differs from it in the comparison; a pair
whose conversation has no rows has an empty completion there and an empty prompt; conversations alike in all turns give two empty completions;
where one continues the other, the shorter has an empty completion; turns of any length are whole; conversations with null conv_id are in no pair; an empty
table gives an empty result; further columns of turns are ignored, whatever their names. A conversation becomes one
row, as a training example must; nothing else is gathered by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

HEAD, END = "<|", "<|end|>\n"


def rendered(turns: Column) -> Column:
    """array<struct<turn,role,text>> as text."""
    none = F.lit("")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), F.coalesce(t.role, none), F.lit("|>\n"), F.coalesce(t.text, none), F.lit(END))), "")


def masks(turns: Column) -> Column:
    """array<struct<start,end>> in characters of rendered(turns): the assistant's texts with their end marks."""
    none, zero = F.lit(""), F.lit(0).cast("long")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(s: Column, t: Column) -> Column:
        start = s.at + F.length(F.coalesce(t.role, none)) + F.lit(len(HEAD) + 3)
        end = start + F.length(F.coalesce(t.text, none)) + F.lit(len(END))
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(t.role == "assistant", F.concat(s.spans, F.array(span))).otherwise(s.spans).alias("spans"))

    return F.aggregate(turns, F.struct(zero.alias("at"), empty.alias("spans")), step, lambda s: s.spans)


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text. pairs: pair_id, chosen_id, rejected_id (pair_id unique).

    Returns pair_id, chosen_id, rejected_id, n_common long, prompt, chosen, chosen_mask, rejected, rejected_mask.
    """
    named = turns.select("conv_id", F.struct("turn", "role", "text").alias("t"))
    sides = pairs.select("pair_id", F.explode(F.array(
        F.struct(F.lit("c").alias("side"), F.col("chosen_id").alias("conv_id")),
        F.struct(F.lit("r").alias("side"), F.col("rejected_id").alias("conv_id")),
    )).alias("s")).select("pair_id", "s.side", "s.conv_id")
    side = sides.join(named, "conv_id").groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "c", F.col("t")))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "r", F.col("t")))).alias("r"),
    )
    both = pairs.join(side, "pair_id", "left").withColumns({x: F.coalesce(x, F.array().cast("array<struct<turn:bigint,role:string,text:string>>")) for x in "cr"})
    same = F.zip_with("c", "r", lambda a, b: a.role.eqNullSafe(b.role) & a.text.eqNullSafe(b.text) & a.isNotNull() & b.isNotNull())
    first = F.array_position(same, F.lit(False)) - 1
    both = both.withColumn("n_common", F.when(first >= 0, first).otherwise(F.size("c")).cast("long"))
    # what follows the prefix
    rest = {x: F.slice(x, F.col("n_common").cast("int") + 1, F.greatest(F.size(x), F.lit(1))) for x in "cr"}
    both = both.withColumns({"prompt": rendered(F.slice("c", 1, F.col("n_common").cast("int"))), "c": rest["c"], "r": rest["r"]})
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "n_common", "prompt",
        rendered(F.col("c")).alias("chosen"), masks(F.col("c")).alias("chosen_mask"),
        rendered(F.col("r")).alias("rejected"), masks(F.col("r")).alias("rejected_mask"),
    )


def reply_pairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and pairs of a table without ratings: conversation 2k stands as chosen; its rejected counterpart, under the
    number 2k + 1, is the same conversation up to its last assistant turn (all of it, if there is none), from there on
    with what conversation 2k + 1 has from its own last assistant turn on. Conversations without a partner have an
    empty other side (2k alone: the turns before its last reply).
    """
    known = turns.filter("conv_id is not null").select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("even"), "conv_id", "turn", "role", "text")
    last = F.coalesce(F.max(F.when(F.col("role") == "assistant", F.col("turn"))), F.max("turn") + 1, F.lit(0))
    ends = known.groupBy("pair_id", "even", "conv_id").agg(last.cast("long").alias("last"))
    side = lambda even, x: F.max(F.when(F.col("even") == F.lit(even), F.col(x)))
    pairs = ends.groupBy("pair_id").agg(side(True, "conv_id").alias("chosen_id"), side(False, "conv_id").alias("rejected_id"), side(True, "last").alias("own"), side(False, "last").alias("other"))
    rows = known.join(pairs, "pair_id")
    early = F.col("turn").isNull() | (F.col("turn") < F.col("own"))
    kept = rows.filter("even").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    shared = rows.filter(F.col("even") & F.col("rejected_id").isNotNull() & early).select(F.col("rejected_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ending = rows.filter(~F.col("even") & (F.col("turn") >= F.col("other")))
    ending = ending.select("conv_id", (F.col("turn") - F.col("other") + F.coalesce("own", F.lit(0))).cast("long").alias("turn"), "role", "text")
    return kept.unionByName(shared).unionByName(ending), pairs.select("pair_id", "chosen_id", "rejected_id")


def digest(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = preference_pairs(*reply_pairs(turns))
    return out.withColumns({"chosen_mask": digest("chosen_mask"), "rejected_mask": digest("rejected_mask")})


def _side(name: str) -> str:
    body = f"{name}[n_common + 1:]"
    text = f"coalesce(array_to_string(list_transform({body}, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), ''), '')"
    length = "length(coalesce(t.role, '')) + length(coalesce(t.text, '')) + 13"
    start = f"coalesce(list_sum(list_transform({body}[1:i - 1], lambda t: {length})), 0)"
    one = f"CAST(CAST({start} + length(coalesce({body}[i].role, '')) + 5 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST({start} + length(coalesce({body}[i].role, '')) + length(coalesce({body}[i].text, '')) + 13 AS BIGINT) AS VARCHAR)"
    mask = f"coalesce(array_to_string(list_transform(list_filter(range(1, len({body}) + 1), lambda i: {body}[i].role = 'assistant'), lambda i: {one}), ','), '')"
    return f"{text} AS {{0}}, {mask} AS {{0}}_mask"


QUERIES = {"op4_preference_format": op4}
SQL = {
    "op4_preference_format": f"""
WITH k AS (
  SELECT *, CAST(conv_id // 2 AS BIGINT) AS pair_id, conv_id % 2 = 0 AS even FROM conversations WHERE conv_id IS NOT NULL
), e AS (
  SELECT pair_id, max(conv_id) FILTER (even) AS chosen_id, max(conv_id) FILTER (NOT even) AS rejected_id, max(last) FILTER (even) AS own, max(last) FILTER (NOT even) AS other
  FROM (SELECT pair_id, even, conv_id, coalesce(max(turn) FILTER (role = 'assistant'), max(turn) + 1, 0) AS last FROM k GROUP BY ALL) GROUP BY pair_id
), sides AS (
  SELECT pair_id, 'c' AS side, turn, role, text FROM k WHERE even
  UNION ALL SELECT pair_id, 'r', turn, role, text FROM k JOIN e USING (pair_id) WHERE even AND rejected_id IS NOT NULL AND (turn IS NULL OR turn < own)
  UNION ALL SELECT pair_id, 'r', turn - other + coalesce(own, 0), role, text FROM k JOIN e USING (pair_id) WHERE NOT even AND turn >= other
), p AS (
  SELECT e.pair_id, chosen_id, rejected_id,
         coalesce(list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (side = 'c'), []) AS c,
         coalesce(list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (side = 'r'), []) AS r
  FROM e LEFT JOIN sides s ON s.pair_id = e.pair_id GROUP BY e.pair_id, chosen_id, rejected_id
), n AS (
  SELECT *, CAST(coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i: c[i] IS NULL OR r[i] IS NULL
         OR c[i].role IS DISTINCT FROM r[i].role OR c[i].text IS DISTINCT FROM r[i].text)) - 1, len(c)) AS BIGINT) AS n_common FROM p
)
SELECT pair_id, chosen_id, rejected_id, n_common,
       coalesce(array_to_string(list_transform(c[1:n_common], lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), ''), '') AS prompt,
       {_side('c').format('chosen')}, {_side('r').format('rejected')}
FROM n
""",
}
