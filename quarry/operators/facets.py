"""Faceted retrieval: the lanes of a question's facets, their allocation, and what bounds and orders them.

Lanes are rows of (query_id, facet_id); everything but the allocation itself, in which each choice depends on those
before, is built-in functions and windows. An allocation walks the few candidates of one question.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quarry.functions.text import once
from quarry.functions.unicode import folded

#: Share of the strongest free candidate's score that one of a new document needs to be preferred (fixed value).
NEW_DOCUMENT = 0.75
#: Lanes that come first, by role; all others after them (fixed values).
FIRST_ROLES = {"original": 0, "premise_support": 1, "premise_counter": 1, "framing": 1}
#: Parts of a book in names of documents, folded (fixed patterns).
CHAPTER_ONE = r"\bchapter\s+1\b"
ENDPOINT = r"\b(?:conclusion|epilogue)\b"
SUPPLEMENT = r"\b(?:acknowledg(?:e)?ments?|afterword|appendix|bibliograph(?:y|ies)|credits?|index|notes?|works\s+consulted)\b"
#: How many terms of each kind a document's profile takes, in this order, and how many there are in all (fixed values).
PROFILE = {"title": 4, "acronym": 6, "named": 18, "institutional": 16, "general": 48}
PERIODS, TERMS = 4, 48


def lane_numbers(facets: DataFrame) -> DataFrame:
    """facets (query_id, facet_id, role) with `lane`: the original first, then support, counter and framing, then by id."""
    known = F.coalesce(*[F.when(F.col("role") == r, F.lit(p)) for r, p in FIRST_ROLES.items()], F.lit(2))
    return facets.withColumn("lane", F.row_number().over(W.partitionBy("query_id").orderBy(known, "facet_id")))


def stage_positions(facets: DataFrame, requirements: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """query_id, facet_id, position (from 0), stages: facets of a stage role with exactly one known requirement, by its order.

    facets: query_id, facet_id, role, requirement_ids; requirements: query_id, requirement_id, order.
    """
    own = facets.filter(F.col("role").isin(*roles) & (F.size("requirement_ids") == 1)).withColumn("requirement_id", F.get("requirement_ids", F.lit(0)))
    own = own.join(requirements, ["query_id", "requirement_id"])
    q = W.partitionBy("query_id")
    return own.select("query_id", "facet_id", (F.row_number().over(q.orderBy("order", "facet_id")) - 1).alias("position"), F.count("*").over(q).alias("stages"))


def structure_label(name: Column) -> Column:
    return F.trim(F.regexp_replace(folded(name), "[^a-z0-9]+", " "))


def narrative_span(documents: DataFrame) -> DataFrame:
    """Documents of a collection from chapter 1 on (or the first) to the last endpoint before supplemental matter (or all before
    it); all, where that is none. documents: collection, document, ordinal."""
    c = W.partitionBy("collection")
    rows = documents.withColumn("__l", structure_label(F.col("document")))
    at = lambda cond, pick=F.min: pick(F.when(cond, F.col("ordinal"))).over(c)
    rows = rows.withColumn("__from", F.coalesce(at(F.col("__l").rlike(CHAPTER_ONE)), F.min("ordinal").over(c)))
    rows = rows.withColumn("__extra", F.coalesce(at((F.col("ordinal") >= F.col("__from")) & F.col("__l").rlike(SUPPLEMENT)), F.max("ordinal").over(c) + 1))
    last = at((F.col("ordinal") >= F.col("__from")) & (F.col("ordinal") < F.col("__extra")) & F.col("__l").rlike(ENDPOINT), F.max)
    rows = rows.withColumn("__to", F.coalesce(last + 1, F.col("__extra")))
    inside = (F.col("ordinal") >= F.col("__from")) & (F.col("ordinal") < F.col("__to"))
    rows = rows.withColumn("__in", inside).withColumn("__any", F.bool_or("__in").over(c))
    return rows.filter(F.col("__in") | ~F.col("__any")).select(*documents.columns)


def distinctive_terms(intent: Column, original: Column, generic: Column) -> Column:
    """Terms of a stage's intent that neither the question nor the generic words have."""
    return F.array_except(F.array_except(intent, original), generic)


def extend_unique(selected: Column, candidates: Column, limit: int, capacity: Column | int) -> Column:
    """selected and up to `limit` candidates that are new, in order, as long as there is room."""
    room = F.greatest(F.least(F.lit(limit), F.lit(capacity) - F.size(selected) if isinstance(capacity, int) else capacity - F.size(selected)), F.lit(0))
    return F.concat(selected, F.slice(F.array_except(candidates, selected), F.lit(1), room))


def occurrences(text: Column) -> Column:
    """array<struct<token, named, acronym>>: words with a letter, folded, and whether they are written with a capital or all in capitals."""
    words = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: w.rlike(r"\p{L}|^(?:1[0-9]{3}|20[0-9]{2})$") & F.length(w).between(2, 48))
    return F.transform(words, lambda w: F.struct(folded(w).alias("token"), w.rlike(r"^\p{Lu}").alias("named"), w.rlike(r"^[\p{Lu}\p{N}]{2,}$").alias("acronym")))


def role_profiles(chunks: DataFrame, generic: tuple[str, ...], vocabulary: tuple[str, ...]) -> DataFrame:
    """document and its terms: quotas of title words, acronyms, named and institutional words, then the most telling ones,
    then periods. chunks: document, title, text; tf-idf with a bonus of 1.5 for words of the title."""
    year = F.col("token").rlike("^(?:1[0-9]{3}|20[0-9]{2})$")
    words = chunks.select("document", F.inline(occurrences(F.col("text")))).filter(~F.col("token").isin(*generic))
    tf = words.groupBy("document", "token").agg(F.count("*").alias("n"), F.count_if("named").alias("named"), F.count_if("acronym").alias("acronym"))
    titles = chunks.select("document", F.explode(F.transform(occurrences(F.col("title")), lambda o: o.token)).alias("token")).filter(~F.col("token").isin(*generic)).distinct().withColumn("titled", F.lit(True))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    size = chunks.agg(F.countDistinct("document").alias("docs"))  # one number
    rows = tf.join(df, "token").join(titles, ["document", "token"], "full").crossJoin(F.broadcast(size))
    score = (1 + F.log("n")) * (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1) + F.when(F.col("titled"), 1.5).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.withColumns({"score": F.round(F.when(~year, F.coalesce(score, F.lit(0.0))), 9), "n": zero("n"), "named": zero("named"), "acronym": zero("acronym")})
    known = F.exists(F.array(*[F.lit(v) for v in vocabulary]), lambda v: (F.col("token") == v) | ((F.least(F.length("token"), F.length(v)) >= 5) & (F.startswith("token", v) | F.startswith(v, F.col("token")))))

    def ranked(cond: Column, by: str) -> Column:
        s = F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), (-F.col(by)).alias("n"), F.col("token").alias("t"))
        return F.transform(F.array_sort(F.collect_list(F.when(cond, s))), lambda x: x.t)

    lists = rows.groupBy("document").agg(
        ranked(F.col("titled") & ~year, "n").alias("title"), ranked(F.col("acronym") > 0, "acronym").alias("acronym"), ranked(F.col("named") > 0, "named").alias("named"),
        ranked(~year & known & (F.col("n") > 0), "n").alias("institutional"), ranked(~year & (F.col("n") > 0), "n").alias("general"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(year & (F.col("n") > 0), F.struct((-F.col("n")).alias("n"), F.col("token").alias("t"))))), lambda x: x.t), 1, PERIODS).alias("periods"))
    lists = lists.withColumn("terms", F.array().cast("array<string>"))
    for kind, limit in PROFILE.items():
        lists = lists.withColumn("terms", extend_unique(F.col("terms"), F.col(kind), limit, TERMS - F.size("periods")))
    return lists.select("document", extend_unique(F.col("terms"), F.col("periods"), PERIODS, TERMS).alias("terms"))


def pick_first(candidates: list, used: set, documents: set, prefer_new: bool):
    """The first unused candidate (chunk_id, document, score); of a new document, if one is within the band of the first's score."""
    free = [c for c in candidates if c[0] not in used]
    if not free or not prefer_new:
        return free[0] if free else None
    strongest = free[0][2]
    return next((c for c in free if c[1] not in documents and (strongest <= 0 or c[2] >= strongest * NEW_DOCUMENT)), free[0])


def allocate(lanes: DataFrame, limit: int = 8, prefer_new: bool = False) -> DataFrame:
    """query_id, facet_id, chunk_id, source_number: one candidate of each lane in lane order, then round robin until `limit`.

    lanes: query_id, facet_id, lane, chunk_id, document, score, rank. A lane whose best chunk is selected already shares it.
    """
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["lane", "rank", "chunk_id"])
        held = {f: list(zip(g.chunk_id, g.document, g.score, strict=True)) for f, g in rows.groupby("facet_id", sort=False)}
        number: dict[str, int] = {}
        documents: set = set()
        given: dict[tuple, int] = {}

        def accept(facet: str, c: tuple) -> bool:
            fresh = c[0] not in number
            if fresh and len(number) >= limit:
                return False
            documents.add(c[1])
            given[facet, c[0]] = number.setdefault(c[0], len(number) + 1)
            return fresh

        for facet, cs in held.items():
            if cs[0][0] in number:
                accept(facet, cs[0])
            elif len(number) < limit and (c := pick_first(cs, set(number), documents, prefer_new)):
                accept(facet, c)
        turns = {facet: iter(cs) for facet, cs in held.items()}
        moved = True
        while moved and len(number) < limit:
            moved = False
            for facet, rest in turns.items():
                moved |= any(accept(facet, c) for c in rest) if len(number) < limit else False
        query = pdf.query_id.iloc[0]
        return pd.DataFrame([(query, f, c, n) for (f, c), n in given.items()], columns=["query_id", "facet_id", "chunk_id", "source_number"])

    return lanes.groupBy("query_id").applyInPandas(walk, "query_id long, facet_id string, chunk_id string, source_number long")


def remapped(allocated: DataFrame, kept: DataFrame) -> DataFrame:
    """Facets' sources after a filter: numbered anew in the old order. kept: query_id, chunk_id."""
    rows = allocated.join(kept.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")
    return rows.withColumn("source_number", F.dense_rank().over(W.partitionBy("query_id").orderBy("source_number")))


def promote(context: DataFrame, facets: DataFrame, anchors: DataFrame, limit: int = 8) -> DataFrame:
    """query_id, source_number, chunk_id, origin, protected: contexts with the chunks that a scan of the corpus certified.

    Each facet keeps the first of its sources that no facet before it keeps. Anchors are admitted in their order as long as
    there is room beside those; then come the other sources, first one of each document that is not there yet.
    context: query_id, chunk_id, document, source_number; facets: the same and facet_id, for those to protect; anchors: query_id,
    chunk_id, document, place. A context without anchors stays as it is. A question's few sources are one row.
    """
    pair = F.struct("chunk_id", "document")
    in_order = lambda df, at: df.groupBy("query_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), pair.alias("c")))), lambda x: x.c)).alias("cs"))
    per = facets.groupBy("query_id", "facet_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_number", pair.alias("c")))), lambda x: x.c).alias("cs"))
    per = per.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("facet_id", "cs"))), lambda x: x.cs).alias("lanes"))
    # an anchor's first place before they are gathered: arrays of structs are made distinct by comparing all pairs
    firsts = anchors.groupBy("query_id", "chunk_id", "document").agg(F.min("place").alias("place"))
    asked = firsts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", pair.alias("c")))), lambda x: x.c).alias("cs"))
    rows = in_order(context, "source_number").withColumnRenamed("cs", "old").join(asked.withColumnRenamed("cs", "asked"), "query_id", "left").join(per, "query_id", "left")
    kind = rows.schema["old"].dataType
    none = F.array().cast(kind)
    rows = rows.withColumns({"asked": F.coalesce("asked", none), "lanes": F.coalesce("lanes", F.array().cast(T.ArrayType(kind)))})
    rows = rows.withColumn("guarded", F.aggregate("lanes", none, lambda s, cs: F.concat(s, F.slice(F.array_except(cs, s), 1, 1))))
    fresh = F.slice(F.filter("asked", lambda c: ~F.array_contains("guarded", c)), F.lit(1), F.greatest(F.lit(limit) - F.size("guarded"), F.lit(0)))
    # once, not anew for each of the anchors
    rows = rows.withColumn("admitted", once(fresh, lambda new: F.filter("asked", lambda c: F.array_contains("guarded", c) | F.array_contains(new, c))))
    rows = rows.withColumn("must", F.array_distinct(F.concat("admitted", "guarded"))).withColumn("rest", F.array_except("old", "must"))
    start = F.struct(none.alias("new"), none.alias("same"), F.transform("must", lambda c: c.document).alias("docs"))

    def fill(s: Column, c: Column) -> Column:
        seen = F.array_contains(s.docs, c.document)
        more = F.array(c)
        return F.struct(F.when(seen, s.new).otherwise(F.concat(s.new, more)).alias("new"), F.when(seen, F.concat(s["same"], more)).otherwise(s["same"]).alias("same"), F.when(seen, s.docs).otherwise(F.concat(s.docs, F.array(c.document))).alias("docs"))

    rows = rows.withColumn("filled", F.aggregate("rest", start, fill))
    final = F.when(F.size("asked") == 0, F.col("old")).otherwise(F.slice(F.concat("must", "filled.new", "filled.same"), 1, limit))
    out = rows.select("query_id", "old", "guarded", F.posexplode(final).alias("pos", "c"))
    origin = F.when(F.array_contains("old", F.col("c")), "retrieval").otherwise("corpus_anchor")
    return out.select("query_id", (F.col("pos") + 1).alias("source_number"), "c.chunk_id", origin.alias("origin"), F.array_contains("guarded", F.col("c")).alias("protected"))
