"""Serving-side data semantics: routing, faceted allocation, history bounds, help matching, rate and budget gates.

What depends on the choices before it (gates with feedback, lane allocation) is walked in Python for each key; all
else is built-in functions and windows.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quarry.functions.unicode import folded, osa

#: Limits of the history sent along (fixed values).
TURNS, HISTORY_CHARS = 6, 16_000
_DOES = r"\s+(?:did|does|do|was|were|is|are|has|have|had)\b"
_BOOK = r"(?:(?:the|this|that)\s+)?(?:manuscript|book|text|author|account)\s+"
#: Signs of what a question needs (fixed patterns).
BROAD = (
    r"\b(?:change(?:d|s|ing)?|develop(?:ed|ment|ments|ing)?|evolv(?:e|ed|es|ing)|trajectory|lineage|history)\b.{0,60}\b(?:over time|through time|across|throughout|from|between)\b",
    r"\b(?:trace|outline|survey)\b.{0,80}\b(?:change|development|evolution|history|lineage|stages?)\b",
    r"\bfrom\b.{1,160}\bto\b",
    r"\bbetween\b.{1,160}\band\b",
    r"\b(?:over time|throughout the|over the course of)\b",
)
COORDINATED = r"(?:[;?]\s*|,\s*|\s+)(?:and|also)\s+(?:what|why|how|when|where|who|which|compare|identify|explain|describe)\b"
ENUMERATED = r"(?:^|\n)\s*(?:\d+[\).]|[a-z][\).]|[-*])\s+"
PLURAL = r"\b(?:several|multiple|different|distinct|main|major)\s+(?:causes|mechanisms|stages|comparisons|consequences)\b"
DIMENSIONS = r"\b(?:causes?|mechanisms?|stages?|comparisons?|consequences?)\b"
RELATIONAL = r"(?:connect(?:s|ed|ing)?|relat(?:e|es|ed|ing)|link(?:s|ed|ing)?)"
RELATES_TO = rf"\b{RELATIONAL}\b[^?.!]{{0,160}}\bto\b"
BETWEEN = r"\b(?:relationship|connection|relation)\s+between\b"
ABSENCE = (
    r"\b(?:(?:does|do|did|how|whether|what)\s+)?(?:the\s+)?(?:book|manuscript|text|author|account)\b.{0,80}\b(?:address(?:es)?|cover(?:s|ed)?|discuss(?:es|ed)?|mention(?:s|ed)?|say(?:s)?\s+about|treat(?:s|ed)?)\b",
    r"\b(?:what|whether|how)\b.{0,100}\b(?:addressed|covered|discussed|mentioned|treated)\b.{0,50}\b(?:book|manuscript|text|account)\b",
)
PREMISE = (
    r"\b(?:why|how)\b.{0,60}\b(?:book|manuscript|author|account)\b.{0,60}\b(?:argues?|attributes?|claims?|dates?|describes?|identifies?|places?|says?)\b",
    r"\b(?:given that|assuming that|because|in light of the fact that|according to|on the assumption that)\b",
    rf"\bwhy{_DOES}",
    rf"\bhow{_DOES}.{{0,180}}\b(?:caus(?:e|es)(?!\s+of\b)|caused|causing|creat(?:e|ed|es|ing)|found(?:ed|ing)?|begin|began|start(?:ed|ing)?|originat(?:e|ed|es|ing)|lead|led|prevent(?:ed|ing)?|prov(?:e|ed|es|ing)|first)\b",
)
#: Whole questions for a relationship between two things, and for a comparison of two (groups: left, right, context; body, right).
PAIRS = (
    rf"^\s*(?:(?:how|what)\s+(?:does|do|did)\s+{_BOOK}(?:describe|frame|present|treat)\s+(?:(?:the|a)\s+)?|what\s+(?:is|was)\s+(?:(?:the|a)\s+)?)(?:relationship|connection|relation)\s+between\s+"
    r"([^?.!,;]{1,120}?)\s+and\s+([^?.!,;]{1,120}?)(\s+(?:as|in)\s+(?:shaping|affecting|influencing|changing|forming)\b[^?.!,;]{0,150})?\s*[?.!]?\s*$",
    r"^\s*how\s+(?:does|do|did)\s+(?:(?:the|a)\s+)?(?:relationship|connection|relation)\s+between\s+([^?.!,;]{1,120}?)\s+and\s+([^?.!,;]{1,120}?)(\s+(?:shape|affect|influence|change|form)\b[^?.!,;]{1,150})\s*[?.!]?\s*$",
)
_COMPARE = rf"^\s*(?:how|what)\s+(?:does|do|did)\s+{_BOOK}(?:explain|describe|frame|present|treat|compare)\s+(?:(?:the|a)\s+)?(?:causes?|mechanisms?|consequences?)\s+of\s+"
COMPARISON_SYNTAX = _COMPARE + r"[^\r\n]{1,280}?\s+(?:versus|vs\.?)\s+[^\r\n]{1,120}?\s*[?.!]?\s*$"
COMPARISON = _COMPARE + r"([^?.!,;\r\n]{3,225}?)\s+(?:versus|vs\.?)\s+([^?.!,;\r\n]{1,100}?)\s*[?.!]?\s*$"
_UNSURE = r"\b(?:as|because|although|though|while|when|where|which|who|whose|despite|unless|until|given|assuming|according)\b|in\s+light\s+of\s+the\s+fact\s+that|on\s+the\s+assumption\s+that"
UNSURE_OPERAND = _UNSURE + r"|\b(?:during|after|before|over|amid|throughout|under|within|across|in|at|by|from|through|with|without|among)\b|with\s+respect\s+to"
UNSURE_COMPARED = _UNSURE + r"|\bover\s+time\b"
CONTEXT_HEAD = r"^(?:(?:as|in)\s+(?:shaping|affecting|influencing|changing|forming)|(?:shape|affect|influence|change|form))\b"
MAX_QUERY = 240


def _plain(x: Column) -> Column:
    """A query for comparisons: its folded words."""
    return F.array_join(F.regexp_extract_all(folded(x, "NFKC"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def _has(x: Column, pattern: str) -> Column:
    return x.rlike("(?i)" + pattern)


def bounded_pair(question: Column) -> Column:
    """Whether a question asks for nothing but the relationship of two plain things."""
    def one(pattern: str) -> Column:
        part = lambda k: F.trim(F.regexp_extract(question, "(?i)" + pattern, k), F.lit(" ,;:?"))
        left, right, context = part(1), part(2), F.trim(F.regexp_extract(question, "(?i)" + pattern, 3))
        loose = [_has(c, p) for c in (left, right) for p in (r"\band\b", UNSURE_OPERAND)]
        tail = F.regexp_replace(context, "(?i)" + CONTEXT_HEAD, "")
        short = (F.length(left) + F.length(right) + F.length(context) + 25 <= MAX_QUERY)
        return _has(question, pattern) & (left != "") & (right != "") & ~_any(loose) & (_plain(left) != _plain(right)) & ~_has(tail, _UNSURE) & short

    return F.when(_has(question, PAIRS[0]), one(PAIRS[0])).otherwise(one(PAIRS[1]))


def bounded_comparison(question: Column) -> Column:
    """Whether a question compares one dimension of a topic in two plain things."""
    body, right = F.regexp_extract(question, "(?i)" + COMPARISON, 1), F.trim(F.regexp_extract(question, "(?i)" + COMPARISON, 2), F.lit(" ,;:?"))
    topic, left = (F.trim(F.regexp_extract(body, r"(?is)^(.*)\s+in\s+(.*)$", k), F.lit(" ,;:?")) for k in (1, 2))
    loose = [_has(left, UNSURE_COMPARED), _has(right, UNSURE_COMPARED), *(_has(c, r"\b(?:versus|vs\.?)\b") for c in (topic, left, right))]
    return _has(question, COMPARISON) & (topic != "") & (left != "") & (right != "") & (_plain(left) != _plain(right)) & ~_any(loose)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def route_traits(question: Column, has_target: Column) -> Column:
    """Traits of a question in a fixed order, as an array. has_target: whether it names a trusted target; without one, a
    question for what the text covers is a broad one."""
    q, pair, compared = question, bounded_pair(question), bounded_comparison(question)
    covers = _any([_has(q, p) for p in ABSENCE])
    asked = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(q), F.lit(DIMENSIONS), F.lit(0)), lambda w: F.regexp_replace(w, "s+$", "")))
    many = _has(q, COORDINATED) | (F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit(""))) > 1) | (F.regexp_count(q, F.lit("(?i)" + ENUMERATED)) > 1) | _has(q, PLURAL) | (F.size(asked) > 1) | _has(q, COMPARISON_SYNTAX)
    opens = q.rlike(r"(?i)^\s*(?:what|whether|how|does|do|did)\b")
    hit = {
        "broad_synthesis": (_any([_has(q, p) for p in BROAD]) & ~pair) | (covers & ~has_target),
        "multi_part": many,
        "relationship": _has(q, RELATES_TO) | _has(q, BETWEEN),
        "absence_sensitive": covers & has_target,
        "premise_sensitive": ~pair & ~compared & _any([_has(q, p) for p in PREMISE]) & ~(covers & opens),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in hit.items()]))


_NAME = r"[A-Z][^\W_]*(?:[’'][A-Za-z][^\W_]*)?"
#: Surfaces that may be a target, in order of priority after quoted ones and pairs (fixed patterns).
TARGETS = (
    re.compile(rf"\b{_NAME}(?:\s+(?:(?:of|the|and|de|van|von)\s+)?{_NAME})+\b"),
    re.compile(r"\b(?:[A-Z][^\W_]*(?:\s+[A-Z][^\W_]*){0,2})\s+(?:No\.?\s*)?\d+[A-Za-z]?\b"),
    re.compile(r"\b\d+(?:st|nd|rd|th)\s+[A-Z][^\W_]*\b"),
    re.compile(r"\b(?:[A-Z]{2,10}|(?:[A-Z]\.){2,10})\b"),
    re.compile(r"\b[\w]+(?:-[\w]+)+\b"),
)
NAME, ACRONYM, HYPHENATED = 0, 3, 4
QUOTED_TARGET = re.compile(r"\"([^\"\r\n]{1,240})\"|“([^”\r\n]{1,240})”|'([^'\r\n]{2,240})'|‘([^’\r\n]{1,240})’")
NAMED_PAIR = re.compile(r"\bbetween\s+([A-Z][^\W_]*(?:\s+[A-Z][^\W_]*)+)\s+and\s+([A-Z][^\W_]*(?:\s+[A-Z][^\W_]*)+)(?=[\s?.!,;:]|$)")
ASKS_RELATION = re.compile(rf"\b(?:between|compare|comparison|connection|relationship|relation|{RELATIONAL}|versus|vs\.?)\b", re.IGNORECASE)
ACTS_ON = re.compile(
    r"\b(?:affect(?:s|ed|ing)?|impact(?:s|ed|ing)?|influenc(?:e|es|ed|ing)|shap(?:e|es|ed|ing)|alter(?:s|ed|ing)?|transform(?:s|ed|ing)?|caus(?:e|es|ed|ing)|"
    r"trigger(?:s|ed|ing)?|(?:lead(?:s|ing)?|led)\s+to|result(?:s|ed|ing)?\s+in|contribut(?:e|es|ed|ing)\s+to)\b", re.IGNORECASE)
#: Words that lead to a target without belonging to it (fixed values).
LEADING = (
    "a", "an", "compare", "describe", "did", "do", "does", "explain", "how", "identify", "is", "outline", "survey", "the", "trace", "was", "were", "what",
    "when", "where", "which", "who", "why",
)
MAX_TARGETS = 3


def _words(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).casefold()))


def _surfaces(text: str):
    """(start, end, surface, priority) of everything that may be a target."""
    pair = NAMED_PAIR.search(text)
    if pair:
        yield from ((pair.start(k), pair.end(k), pair[k], 0) for k in (1, 2))
    for m in QUOTED_TARGET.finditer(text):
        if surface := next(g for g in m.groups() if g is not None).strip():
            yield m.start(), m.end(), surface, 0
    for kind, pattern in enumerate(TARGETS):
        for m in pattern.finditer(text):
            if kind == NAME and pair and m.start() <= pair.start(1) and m.end() >= pair.end(2):
                continue
            words = m[0].split()
            while len(words) > 1 and words[0].casefold().rstrip("?:,") in LEADING:
                del words[0]
            surface = " ".join(words).strip(" \t\r\n,;:.?!")
            plain = kind == HYPHENATED and surface.islower() and not any(c.isdigit() for c in surface)
            if surface and not plain and not (kind == ACRONYM and surface.casefold() in LEADING):
                yield m.start(), m.end(), surface, kind + 1


def targets_of(question: str | None, said: str | None = None) -> list[dict]:
    """At most three targets: from the left, longest first, none overlapping another or naming the same; a facet is any but
    the first where a relationship is asked for. checkable: the surface occurs in what the user said (the question itself)."""
    if question is None:
        return []
    out: list[tuple[int, int, str]] = []
    for start, end, surface, _ in sorted(_surfaces(question), key=lambda x: (x[0], x[0] - x[1], x[3])):
        name = _words(surface)
        if name and all(name != _words(s) and (start >= b or end <= a) for a, b, s in out):
            out.append((start, end, surface))
            if len(out) == MAX_TARGETS:
                break
    acts = len(out) > 1 and ACTS_ON.search(question[out[0][1]:out[1][0]])
    related = bool(ASKS_RELATION.search(question) or acts)
    trusted = f" {_words(question if said is None else said)} "
    return [{"target_id": f"T{i}", "start": a, "text": s, "role": "facet" if related and i > 1 else "subject", "checkable": f" {_words(s)} " in trusted} for i, (a, _, s) in enumerate(out, 1)]


_TARGET = T.StructType([T.StructField("target_id", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("role", T.StringType()), T.StructField("checkable", T.BooleanType())])


@F.pandas_udf(T.ArrayType(_TARGET))
def trusted_targets(question: pd.Series) -> pd.Series:
    """targets_of each question: offsets of matches, which no built-in function gives."""
    return question.map(targets_of)


#: Questions about the product itself, at any turn and at the first one, and words that change their meaning (fixed values).
HELP = (
    "what do you do", "what do you do here", "what do you do there", "what can you do", "what is archivist", "what is the archivist", "what's archivist",
    "what's the archivist", "what is your purpose", "what are you here for", "how can you help me", "how can you help us", "what can you help me with",
    "what can i ask you", "what should i ask you", "how does archivist work", "how does the archivist work", "how do i use archivist", "how do i use the archivist",
)
FIRST_HELP = ("how does this work", "how do i use this")
OTHER_MEANING = {
    "archivist": ("archivism",), "help": ("helm", "tell"), "purpose": ("purse",), "this": ("his",), "use": ("sue",), "work": ("cork", "fork", "word", "worm"),
    "you": ("her", "him", "them"), "your": ("our",),
}
HELP_CHARS, TYPOS = 160, 3


def is_help(question: str | None, first_turn: bool, approved: tuple[str, ...] = HELP, at_first: tuple[str, ...] = FIRST_HELP) -> bool:
    """Whether a question is one of the approved ones but for typing errors: the nearest of them has to be one whose words
    were not replaced by words of another meaning."""
    if question is None or "\n" in question or "\r" in question:
        return False
    plain = unicodedata.normalize("NFKC", question).strip().casefold().replace("’", "'")
    plain = " ".join("".join(c if c.isalnum() or c in "' " else " " for c in plain).split())
    return bool(plain) and len(plain) <= HELP_CHARS and (_near(plain, approved) or (first_turn and _near(plain, at_first)))


def _near(said: str, approved: tuple[str, ...]) -> bool:
    words, found = said.split(), []
    for known in approved:
        theirs = known.split()
        if said.replace(" ", "") == known.replace(" ", ""):
            return True
        if len(words) == len(theirs):
            each = [(osa(a, b), a, b) for a, b in zip(words, theirs, strict=True)]
            if all(n <= 1 or (n <= 2 and len(b) >= 4 and sorted(a) == sorted(b)) for n, a, b in each) and (total := sum(n for n, _, _ in each)) <= TYPOS:
                found.append((total, any(a in OTHER_MEANING.get(b, ()) for _, a, b in each)))
        elif abs(len(words) - len(theirs)) == 1 and (n := osa(said, known)) <= 2:
            found.append((n, False))
    return (min(found)[0], False) in found if found else False


def help_matcher(approved: tuple[str, ...] = HELP, at_first: tuple[str, ...] = FIRST_HELP):
    """pandas UDF (question, whether it opens the conversation) of is_help."""
    @F.pandas_udf(T.BooleanType())
    def matches(question: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([is_help(q, bool(f), approved, at_first) for q, f in zip(question, first, strict=True)], dtype=bool)

    return matches


def bounded_history(turns: DataFrame) -> DataFrame:
    """The last TURNS turns of a conversation, without the oldest beyond HISTORY_CHARS. turns: conv_id, turn, chars."""
    back = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumns({"n": F.row_number().over(back), "total": F.sum("chars").over(back.rowsBetween(W.unboundedPreceding, 0))})
    return rows.filter((F.col("n") <= TURNS) & (F.col("total") <= HISTORY_CHARS)).select("conv_id", "turn", F.col("total").alias("chars_from_here"))


def followup_subject(turns: DataFrame) -> DataFrame:
    """conv_id, turn, subject: the latest subject of the user's turns before. turns: conv_id, turn, subject (null where none)."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return turns.withColumn("latest", F.last("subject", ignorenulls=True).over(before))


def bands(items: DataFrame, n_bands: int) -> DataFrame:
    """band and its neighbours for items in order (ordinal from 0): floor of n_bands * ordinal / count, the last closed."""
    n = F.count("*").over(W.partitionBy(F.lit(0)))
    band = F.least(F.lit(n_bands - 1).cast("long"), F.floor(F.col("ordinal") * n_bands / n))
    return items.withColumn("band", band)


def apportion(sources: DataFrame, slots: int) -> DataFrame:
    """source, length, scopes: at least one scope each, the rest by highest averages (length / scopes), ties to the earlier."""
    more = sources.filter("length > 1").select("query_id", "source", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("j"), "length")
    order = W.partitionBy("query_id").orderBy(F.desc(F.col("length") / F.col("j")), "source")
    spare = sources.groupBy("query_id").agg((slots - F.count("*")).alias("spare"))
    won = more.withColumn("r", F.row_number().over(order)).join(spare, "query_id").filter("r <= spare").groupBy("query_id", "source").agg(F.count("*").alias("extra"))
    return sources.join(won, ["query_id", "source"], "left").select("query_id", "source", "length", (F.coalesce("extra", F.lit(0)) + 1).alias("scopes"))


class Gate:
    """One instance's gate: rates over sliding 60 seconds, then requests at once, each by category (of a client; of all for
    those at once), client and all. Refused requests count nowhere; None: no limit.
    """

    def __init__(self, rates: tuple, at_once: tuple):
        self.rates, self.at_once = rates, at_once
        self.seen: dict[tuple, deque] = {}
        self.active: dict[tuple, int] = {}
        self.leaving: list[tuple[float, tuple]] = []

    def enter(self, client: str, category: str, now: float, seconds: float) -> str:
        while self.leaving and self.leaving[0][0] <= now:
            for key in heapq.heappop(self.leaving)[1]:
                self.active[key] -= 1
        rate_keys = ((client, category), (client,), ())
        for key, limit, name in zip(rate_keys, self.rates, ("category", "client", "global"), strict=True):
            queue = self.seen.setdefault(key, deque())
            while queue and queue[0] <= now - 60:
                queue.popleft()
            if limit is not None and len(queue) >= limit:
                return f"{name}_rate_limit"
        busy_keys = (("category", category), ("client", client), ())
        for key, limit, name in zip(busy_keys, self.at_once, ("category", "client", "global"), strict=True):
            if limit is not None and self.active.get(key, 0) >= limit:
                return f"{name}_concurrency_limit"
        for key in rate_keys:
            self.seen[key].append(now)
        for key in busy_keys:
            self.active[key] = self.active.get(key, 0) + 1
        heapq.heappush(self.leaving, (now + seconds, busy_keys))
        return "admitted"


def rate_gate(requests: DataFrame, rates: tuple, at_once: tuple) -> DataFrame:
    """id and decision of requests (instance, id, client, category, at, seconds) in time order.

    A decision depends on all before it at the same instance, so an instance is walked by one task; its requests are
    what one process of the service takes, and instances are independent.
    """
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        gate, rows = Gate(rates, at_once), pdf.sort_values(["at", "id"])
        each = zip(rows["client"], rows["category"], rows["at"], rows["seconds"], strict=True)
        return pd.DataFrame({"id": rows["id"].tolist(), "decision": [gate.enter(c, k, t, n) for c, k, t, n in each]})

    return requests.groupBy("instance").applyInPandas(walk, "id long, decision string")


def admit_within(events: DataFrame, ceiling: int) -> DataFrame:
    """Admission with feedback: an event counts only if it is admitted; unpriced ones are refused. events: id, key, at, cost."""
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, spent, out = pdf.sort_values(["at", "id"]), 0, []
        for i, cost in zip(rows["id"].tolist(), rows["cost"].tolist(), strict=True):
            ok = cost == cost and cost is not None and spent + cost <= ceiling
            spent += int(cost) if ok else 0
            out.append((i, ok, spent))
        return pd.DataFrame(out, columns=["id", "admitted", "spent"])

    return events.groupBy("key").applyInPandas(walk, "id long, admitted boolean, spent long")
