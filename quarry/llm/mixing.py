"""Temperature mixing of sources under a token budget, realised as block permutations. DataFrame operations only.

Shares p of the sources' tokens become weights p**alpha / sum(p**alpha). alpha is the smallest exponent in
[0, 1] whose weights have at most the target entropy and repeat no source more than `repeat_limit` times; both
conditions are monotone in alpha, so it is bisected (five levels a pass, see `solve_alpha`). A source's quota is
floor(budget * weight) tokens. Its documents are dealt by hash into blocks of about `block_tokens` tokens; full epochs take every
block, the last epoch takes blocks in a permuted order until the quota is used, and cuts the last block by document.
The order's prefix sums are taken in two levels, so that no task has all blocks of a source: a window has a part of
about `part_blocks` blocks, and another one the sums of a source's parts.

Where no exponent in [0, 1] meets both conditions (a budget beyond `repeat_limit` times the tokens, or a target entropy below
the sources' own), ValueError is raised before anything is drawn.

Defined results: documents with equal keys (rows that repeat a document) are ordered by doc_id and tokens, and may swap places
with each other only; a text of any length counts whole; a null source is a source of its own; documents without words (null, empty or blank text) hold no
tokens and are never drawn; rows that repeat a doc_id are separate documents with the same place in the
permutation; an empty table gives an empty result; further columns are carried along, whatever their names
(but those named like results or with two leading underscores are dropped).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.llm.common import table, without, written


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def solve_alpha(sources: DataFrame, budget: float, total: float, target_entropy: float | None, repeat_limit: float) -> tuple[float, float]:
    """alpha and the sum of p**alpha; sources has one row (__n tokens) for each source.

    Each pass evaluates 31 inner points of the interval over the sources table, i.e. five bisections at once.
    """
    p = F.col("__n") / F.lit(float(total))
    kinds, least, h1 = sources.agg(F.count("*"), F.min(p), -F.sum(p * F.log(p))).first()
    goal = h1 + 0.5 * (math.log(kinds) - h1) if target_entropy is None else target_entropy

    def good(alpha: float, z: float, plogp: float) -> bool:
        entropy = math.log(z) - alpha * plogp / z
        repeats = budget / total * least ** (alpha - 1) / z
        return entropy <= goal + 1e-12 and repeats <= repeat_limit * (1 + 1e-12)

    def sums(points: list[float]) -> list[tuple[float, float]]:
        row = sources.agg(*[f(p ** F.lit(a)) if k == 0 else F.sum(p ** F.lit(a) * F.log(p)) for a in points for k, f in ((0, F.sum), (1, None))]).first()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(points))]

    low, high = 0.0, 1.0
    (z0, l0), (z1, l1) = sums([0.0, 1.0])
    if not good(1.0, z1, l1):
        raise ValueError("no exponent in [0, 1] meets the entropy target and the repetition limit")
    if good(0.0, z0, l0):
        return 0.0, z0
    best = z1
    for _ in range(5):
        points = [low + (high - low) * i / 32 for i in range(1, 32)]
        for a, (z, plogp) in zip(points, sums(points), strict=True):
            if good(a, z, plogp):
                high, best = a, z
                break
            low = a
    return high, best


def mix(docs: DataFrame, *, carry: list[str] | None = None, budget: int | None = None, target_entropy: float | None = None, repeat_limit: float = 4.0, block_tokens: int = 250_000, part_blocks: int = 1024, seed: int = 17, source: str = "source", text: str = "text") -> DataFrame:
    """A row for each draw: the columns to carry (all if None), mix_tokens, mix_epoch, mix_block (place of the block in its epoch) and mix_order (place in the block).

    Texts are read once, to count words; all else works on a table of the columns carried. budget: tokens to draw,
    as many as there are if None. target_entropy: in nats; half way from the sources' own to the uniform one if None.
    """
    docs = without(docs, "mix_tokens", "mix_epoch", "mix_block", "mix_order")
    keep = list(docs.columns if carry is None else carry)
    named = docs.select(
        *keep,
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("__src"),
        word_count(F.col(text)).alias("__tok"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(text)).alias("__key"),
        F.col("doc_id").alias("__id"),
    )
    named = written(named.filter("__tok > 0"), "mix-documents")
    sources = written(named.groupBy("__src").agg(F.sum("__tok").alias("__n")), "mix-sources")
    total = sources.agg(F.sum("__n")).first()[0]
    extra = {"mix_tokens": F.col("__tok"), "mix_epoch": F.lit(0), "mix_block": F.lit(0).cast("long"), "mix_order": F.col("__key")}
    if not total:
        return named.withColumns(extra).select(*keep, *extra)
    budget = total if budget is None else budget
    alpha, z = solve_alpha(sources, budget, total, target_entropy, repeat_limit)
    quota = F.floor(F.lit(float(budget)) * (F.col("__n") / F.lit(float(total))) ** F.lit(alpha) / F.lit(z) + F.lit(1e-6))
    plan = sources.withColumn("__quota", quota).withColumns({"__full": F.floor(F.col("__quota") / F.col("__n")).cast("int"), "__left": F.col("__quota") % F.col("__n")})
    # blocks of about block_tokens tokens; a source's number of blocks follows its own size
    plan = plan.withColumns({"__blocks": F.ceil(F.col("__n") / F.lit(float(block_tokens))).cast("long"), "__parts": F.ceil(F.col("__n") / F.lit(float(block_tokens) * part_blocks)).cast("long")})
    dealt = named.join(plan.select("__src", "__blocks"), "__src").withColumn("__blk", F.pmod("__key", F.col("__blocks"))).drop("__blocks")
    blocks = dealt.groupBy("__src", "__blk").agg(F.sum("__tok").alias("__bn"))
    # blocks permuted by hash; their prefix sums in two levels: over parts of the hash range, then within each part
    turn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("__full"), F.col("__src"), F.col("__blk")), 1)
    blocks = blocks.join(plan, "__src").withColumn("__turn", turn)
    blocks = blocks.withColumn("__part", F.least(F.floor(F.col("__turn") / F.lit(float(1 << 63)) * F.col("__parts")), F.col("__parts") - 1))
    parts = blocks.groupBy("__src", "__part").agg(F.sum("__bn").alias("__sum"), F.count("*").alias("__count"))
    so_far = W.partitionBy("__src").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("__src", "__part", F.coalesce(F.sum("__sum").over(so_far), F.lit(0)).alias("__before"), F.coalesce(F.sum("__count").over(so_far), F.lit(0)).alias("__earlier"))
    order = W.partitionBy("__src", "__part").orderBy("__turn", "__blk")
    chosen = blocks.join(parts, ["__src", "__part"]).withColumns({
        "__end": F.col("__before") + F.sum("__bn").over(order.rowsBetween(W.unboundedPreceding, 0)),
        "__place": F.col("__earlier") + F.row_number().over(order),
    }).withColumn("__room", F.least(F.col("__bn"), F.greatest(F.lit(0).cast("long"), F.col("__left") - (F.col("__end") - F.col("__bn")))))
    chosen = written(chosen.select("__src", "__blk", "__bn", "__full", "__place", "__room"), "mix-blocks")
    drawn = dealt.join(chosen, ["__src", "__blk"])
    epochs = F.sequence(F.lit(0), F.col("__full"))
    epochs = F.slice(epochs, 1, F.col("__full") + (F.col("__room") == F.col("__bn")).cast("int"))
    whole = drawn.withColumn("mix_epoch", F.explode(epochs))
    whole = whole.withColumn("mix_block", F.when(F.col("mix_epoch") == F.col("__full"), F.col("__place")).otherwise(F.pmod(F.xxhash64(F.lit(seed), "mix_epoch", "__src", "__blk"), F.lit(1 << 40))))
    inside = W.partitionBy("__src", "__blk").orderBy("__key", "__id", "__tok")
    cut = dealt.join(chosen.filter("__room > 0 and __room < __bn"), ["__src", "__blk"])
    cut = cut.withColumn("__run", F.sum("__tok").over(inside.rowsBetween(W.unboundedPreceding, 0))).filter("__run <= __room")
    cut = cut.withColumns({"mix_epoch": F.col("__full"), "mix_block": F.col("__place")}).drop("__run")
    out = whole.unionByName(cut)
    return out.withColumns({"mix_tokens": F.col("__tok"), "mix_order": F.col("__key")}).select(*keep, *extra)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])


QUERIES = {"op8_mix_sources": op8}
SQL: dict[str, str] = {}
