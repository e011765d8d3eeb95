"""Small cases of the reference behaviours, closed forms against plain loops, and files."""

import math
import random

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.unicode import folded, nfkd, osa, sequence_ratio
from quarry.operators import corpus as C
from quarry.operators import evidence as E
from quarry.operators import facets as A
from quarry.operators import ledger as L
from quarry.operators import metrics as M
from quarry.operators import quality as Q
from quarry.operators import retrieval as R
from quarry.operators import serving as S
from quarry.sources import tables


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_tokens(spark):
    assert one(spark, X.tokens, "Straße’s  Éclair 12 123 don't rock-n-roll's") == ["strasse", "eclair", "123", "don't", "rock", "n", "roll"]
    assert one(spark, X.query_terms, "What is the Law, the law of a Sea?") == ["law", "sea"]
    assert one(spark, X.quoted_phrases, 'He said “The Law” and "the law"') == ["the law"]
    assert one(spark, X.tokens, None) == []


def test_fold_is_compatibility_decomposition(spark):
    rnd = random.Random(5)
    pools = [range(32, 0x250), range(0x250, 0x3000), range(0x3000, 0xA000), range(0xF900, 0x10000), range(0x1D400, 0x1D800), range(0x300, 0x370), range(0x1E00, 0x2200)]
    texts = ["Dvořák Łódź ﬁne Ｆｕｌｌ ½ ﷺ Straße ΟΔΟΣ ǅ ĳ", "’s"] + ["".join(chr(rnd.choice(pool)) for pool in rnd.choices(pools, k=rnd.randint(1, 30))) for _ in range(3000)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", folded(F.col("x"))).collect()
    assert all(r[1] == nfkd(texts[r[0]]) for r in got), [(texts[r[0]], r[1], nfkd(texts[r[0]])) for r in got if r[1] != nfkd(texts[r[0]])][:3]
    assert one(spark, X.tokens, "Dvořák Łódź ﬁne Ｆｕｌｌ’s ① ٣ ٣٤٥") == ["dvorak", "łodz", "fine", "full", "٣٤٥"]
    assert one(spark, X.content_tokens, "한 글 a") == ["한", "글"]


def loop_chunks(ps):
    out, start = [], 0
    while start < len(ps):
        out.append(start)
        if start + 4 >= len(ps):
            break
        p = start + 3
        if ps[p].startswith(X.QUOTES) and p - 1 > start and ps[p - 1].endswith(":"):
            p -= 1
        elif (ps[p].lower().startswith(X.WEAK_STARTS) or len(ps[p]) < 120) and p + 1 < len(ps):
            p += 1
        start = p
    return out


def test_chunk_starts_against_loop(spark):
    rnd, long = random.Random(2), "word " * 30
    cases = [[rnd.choice(["short", long + "end", "“" + long, long + "as follows:", "However, " + long]).strip() for _ in range(rnd.randint(0, 14))] for _ in range(80)]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "ps array<string>").select(X.chunk_starts(F.col("ps"))).collect()]
    assert sorted(map(str, got)) == sorted(str(loop_chunks(c)) for c in cases)


def test_diversity_against_loop(spark):
    rnd, rows, want = random.Random(4), [], {}
    for q in range(60):
        scores = sorted((rnd.random() for _ in range(rnd.randint(1, 15))), reverse=True)
        cands = [(rnd.choice("abc"), s) for s in scores]
        rows += [(q, f"{i:02}", d, i + 1, s) for i, (d, s) in enumerate(cands)]
        picked, deferred, n = [], [], {}
        for i, (d, s) in enumerate(cands):
            if n.get(d, 0) >= 2 or (deferred and s < cands[deferred[0]][1] * 0.75):
                deferred.append(i)
            else:
                picked.append(i)
                n[d] = n.get(d, 0) + 1
        want[q] = [f"{i:02}" for i in (picked + deferred)[:6]]
    got: dict = {}
    for r in R.diversify(spark.createDataFrame(rows, "query_id long, chunk_id string, document string, rank int, rrf_score double"), 6, 2).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == want


def test_context_takes_all_primaries_first(spark):
    p = spark.createDataFrame([(1, "d_002", 1), (1, "d_005", 2)], "query_id long, chunk_id string, position int")
    e = C.id_neighbours(spark.createDataFrame([(f"d_{i:03}",) for i in range(1, 8)] + [("d_1000",)], "chunk_id string"))
    got = [(r.chunk_id, r.origin) for r in R.with_neighbours(p, e).orderBy("source_number").collect()]
    assert got == [("d_002", "primary"), ("d_005", "primary"), ("d_001", "neighbour"), ("d_003", "neighbour"), ("d_004", "neighbour"), ("d_006", "neighbour")]


def test_run_hashes(spark):
    """Equal runs have equal hashes and others don't, whatever the size's binary digits."""
    rnd = random.Random(3)
    rows = [[rnd.choice("abc") for _ in range(rnd.randint(0, 60))] for _ in range(60)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>")
    for size in (1, 2, 5, 8, 12, 45):
        seen: dict = {}
        for r in df.select("i", X.run_hashes(F.col("t"), size).alias("h")).collect():
            t = rows[r.i]
            assert len(r.h) == max(0, len(t) - size + 1)
            for k, h in enumerate(r.h):
                assert seen.setdefault(tuple(h), tuple(t[k:k + size])) == tuple(t[k:k + size])
        assert len(seen) == len(set(seen.values()))


def loop_lexical(queries, chunks):
    """Scores by a loop over all chunks of every query."""
    cuts = {c: t for c, t in chunks}
    mean = max(1.0, sum(map(len, cuts.values())) / len(cuts))
    out = {}
    for q, (terms, content, quoted) in queries.items():
        terms = list(dict.fromkeys(content))
        for c, t in cuts.items():
            score, hit = 0.0, 0
            for w in terms:
                if n := t.count(w):
                    df = sum(w in x for x in cuts.values())
                    score += math.log(1 + (len(cuts) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(t) / mean))
                    hit += 1
            body = " ".join(t)
            score *= 1 + 0.2 * hit / max(1, len(terms))
            score += 0.5 * sum(p in body for p in dict.fromkeys(" ".join(p) for p in zip(content, content[1:]))) + 2 * sum(p in body for p in dict.fromkeys(quoted))
            if terms and score > 0:
                out[q, c] = round(score, 6)
    return out


def test_lexical_against_loop(spark):
    rnd = random.Random(7)
    words = ["lay", "play", "ing", "playing", "red", "reddish", "an", "ant", "anti", "x"]
    chunks = [(f"c{i:02}", [rnd.choice(words) for _ in range(rnd.randint(0, 12))]) for i in range(40)]
    texts = {q: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 5))) for q in range(12)} | {20: "“play” 'x'", 21: '"lay ing" red', 22: '“lay ing red” play', 23: "the and of", 24: '"d"'}
    df = spark.createDataFrame(list(texts.items()), "query_id long, text string")
    cut = {r.query_id: (None, r.c, r.q) for r in df.select("query_id", X.content_tokens(F.col("text")).alias("c"), X.quoted_phrases(F.col("text")).alias("q")).collect()}
    index = spark.createDataFrame([(c, i, t) for i, (c, t) in enumerate(chunks)], "chunk_id string, ordinal int, tokens array<string>")
    got = {(r.query_id, r.chunk_id): round(r.score, 6) for r in R.lexical(df, index, 1000).collect()}
    assert got == loop_lexical(cut, chunks) and len(got) > 100


def test_needles_as_characters(spark):
    texts = [("a", "Some lay reddish Ants here"), ("b", "replay reddish ant"), ("c", "ant"), ("d", "lay-reddish... ANT!"), ("e", None)]
    needles = [(1, "lay reddish ant"), (2, "AN"), (3, "ay red"), (4, "!"), (5, ""), (6, "lay-reddish... ant")]
    got = C.holding(spark.createDataFrame(texts, "chunk_id string, text string"), spark.createDataFrame(needles, "k int, needle string"), "k").collect()
    assert {(r.k, r.chunk_id) for r in got} == {(k, c) for k, n in needles for c, t in texts if t and any(x.isalnum() for x in n) and n.lower() in t.lower()}


def test_page_floor(spark):
    """A passage that repeats goes to a page at or after that of the chunk before; where there is none, the floor stays."""
    w = lambda n: [f"w{n}_{i}" for i in range(30)]
    of = [(1, w(1)), (2, w(2)), (3, w(3)), (4, w(1)), (5, w(5))]
    pages = spark.createDataFrame([(d, *p) for d in "dx" for p in of], "document string, page long, t array<string>")
    chunks = spark.createDataFrame([("d", 1, "a", w(2)), ("d", 2, "b", w(1)), ("d", 3, "c", w(9)), ("d", 4, "e", w(3)), ("d", 5, "f", w(5)), ("x", 1, "g", w(1))], "document string, no int, key string, t array<string>")
    got = Q.locate(chunks.drop("t"), Q.candidates(Q.anchors(chunks, 12, 6), pages, 12, 4, 2)).collect()
    assert {r.key: (r.first_page, r.matched) for r in got} == {"a": (2, 6), "b": (4, 6), "c": (None, None), "e": (None, None), "f": (5, 6), "g": (1, 6)}


def test_as_of(spark):
    known = spark.createDataFrame([("a", 0, 1), ("a", 10, 2), ("b", 5, 3)], "k string, at int, page int")
    asked = spark.createDataFrame([("a", 0, "x"), ("a", 9, "y"), ("a", 10, "z"), ("b", 4, "n")], "k string, at int, id string")
    assert {r.id: r.page for r in Q.as_of(asked, known, "k", "at", "page").collect()} == {"x": 1, "y": 1, "z": 2, "n": None}


def test_compound_anchors(spark):
    said = {"Mary Smith and John Doe": ["Mary Smith", "John Doe"], "Mary Smith & John Doe.": ["Mary Smith", "John Doe"], "World Bank and Mary Smith": None, "Mary and John": None, "mary smith and John Doe": None, "A B and C D and E F": None, "Area 51 Base and Mary Smith": None}
    for x, want in said.items():
        assert one(spark, E.compound_anchors, x) == (want or [x])


def anchor_index(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string").select("chunk_id", E.anchor_tokens(F.col("text")).alias("tokens"), E.explicit_initialisms(F.col("text")).alias("shorts"))


def test_anchor_tokens(spark):
    assert one(spark, E.anchor_tokens, "The U.S. Ｆｕｌｌ–time O’Brien's A1b2 u.n.x1 W.H.O") == ["the", "us", "full", "time", "o'brien", "a", "1", "b", "2", "un", "x", "1", "who"]
    assert sorted(one(spark, E.explicit_initialisms, "NATO, the W.H.O. and U2, aNATO NATOa 42 ABCDEFGHIJKL")) == ["NATO", "U2", "WHO"]


def test_anchor_kinds(spark):
    t = spark.createDataFrame([(1, "World Health Organization"), (2, "Article 9"), (3, "red red")], "target_id long, surface string")
    c = spark.createDataFrame([("a", "the World Health Organization’s rule"), ("b", "Organization of world and of health"), ("c", "W.H.O. said"), ("d", "health"), ("e", "who said"), ("f", "article9 red"), ("g", "red blue red")], "chunk_id string, text string")
    c = anchor_index(spark, [tuple(r) for r in c.collect()])
    got = {(r.target_id, r.chunk_id): r.rule for r in E.scan(t, c).collect()}
    assert got == {(1, "a"): "full_token_sequence", (1, "b"): "twelve_token_window", (1, "c"): "mechanical_initialism", (1, "d"): "partial_token_collision", (2, "f"): "full_token_sequence", (3, "f"): "partial_token_collision", (3, "g"): "twelve_token_window"}


def test_missing_chunk_is_an_error(spark):
    import pytest

    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    ask = lambda *ids: R.looked_up(spark.createDataFrame([(1, i) for i in ids], "query_id int, chunk_id string"), chunks).collect()
    assert sorted((r.chunk_id, r.text) for r in ask("a", "b", "a")) == [("a", "x"), ("a", "x"), ("b", "y")]
    for lost in ("c", None):
        with pytest.raises(Exception, match="no such chunk"):
            ask("a", lost)


def loop_dossier(rows):
    """Units of a question: how many paragraphs each may show is tried from all of them down."""
    units, used = [], 0
    size = lambda ps: -(-len("\n\n".join(ps)) // 4)
    seen, todo = set(), []
    for c, _, text in sorted(rows, key=lambda r: (r[1], r[0])):
        if c not in seen and text and text.strip():
            todo.append((c, [p for p in text.split("\n\n") if p.strip()]))
        seen.add(c)
    for k, (c, ps) in enumerate(todo):
        still = max(0, 4 - len(units) - 1)
        cheapest = sorted(size(q[:1]) for _, q in todo[k + 1:])
        reserve = sum(cheapest[:still]) if still <= len(cheapest) else 0
        for n in range(len(ps), 0, -1):
            if used + size(ps[:n]) + reserve <= 4500:
                units.append((len(units) + 1, c, n, size(ps[:n]), n < len(ps)))
                used += size(ps[:n])
                break
        if len(units) == 8 or (len(units) >= 4 and used >= 2500):
            break
    return units


def test_dossier_against_loop(spark):
    rnd, rows, want = random.Random(21), [], {}
    for q in range(40):
        mine = [(f"c{i:02}", rnd.randint(1, 12), rnd.choice([None, " ", *["\n\n".join("w" * rnd.randint(1, 4000) for _ in range(rnd.randint(1, 5)))] * 6])) for i in range(rnd.randint(1, 14))]
        mine += mine[:1]
        rows += [(q, *r) for r in mine]
        want[q] = loop_dossier(mine)
    got: dict = {q: [] for q in want}
    for r in E.dossier(spark.createDataFrame(rows, "query_id long, chunk_id string, rank int, text string")).orderBy("query_id", "unit").collect():
        got[r.query_id].append((r.unit, r.chunk_id, r.paragraphs, r.tokens, r.shortened))
    assert got == want and any(u[4] for us in want.values() for u in us)


def test_citations(spark):
    cases = [("[Source 1] [Source 2, Source 9] [", 3, (2, 3, 1, 1, 2, 1)), ("] [Source 1; Source 2] [[Source 1]]", 3, (0, 0, 4, 0, 0, 0)), ("", 0, (0, 0, 0, 0, 0, 0))]
    for answer, n, want in cases:
        assert tuple(M.audit_citations(spark.createDataFrame([(answer, n)], "answer string, source_count int")).first())[2:] == want


def test_pricing(spark):
    u = spark.createDataFrame([("gpt-5.6-sol", None, 300_000, 0, 0, 1000), ("gpt-5.6-sol", "priority", 1000, 100, 10, 10), ("gpt-5.6-sol", "default", 1000, 100, 10, 10), ("gpt-5", "priority", 1, 0, 0, 0), ("gpt-5.6-luna-2026-01-01", None, 10, 0, 0, 0), ("?", None, 1, 0, 0, 0)], "model string, service_tier string, input_tokens long, cached_tokens long, cache_write_tokens long, output_tokens long")
    got = [r.cost_nano_usd for r in L.priced(u).collect()]
    assert sorted(got, key=str) == sorted([3_045_000_000, 2 * 4_862_500, 4_862_500, None, 10_000, None], key=str)


def test_budget_without_events(spark):
    e = spark.createDataFrame([], "recorded_at timestamp, cost_nano long")
    assert tuple(L.budget_state(e, "2026-06", 100, 80).first()) == (0, 0.0, False, False, 100)
    assert tuple(L.budget_state(e, "2026-06", None, 80).first()) == (0, None, False, False, None)


def test_edit_measures(spark):
    assert osa("ca", "abc") == 3 and osa("teh", "the") == 1 and osa("", "ab") == 2
    row = spark.createDataFrame([("Éa’s", "abcd", "bcde")], "a string, b string, c string").select(folded(F.col("a")), sequence_ratio("b", "c")).first()
    assert tuple(row) == ("ea's", 0.75)


def test_help_and_targets(spark):
    m = S.help_matcher()
    said = [("what can yuo do", True), ("whatcan you do?", True), ("waht cna you do", True), ("when can you do", False), ("what did they do", False), ("what is our purpose", False), ("what is yuor purpose", True), ("how do i sue archivist", False), ("what can\nyou do", False), (None, False), ("What’s Archivist", True), ("how does this wrok", True)]
    got = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(said)], "i int, x string").select("i", m("x", F.lit(True)).alias("h")).collect()
    assert [r.h for r in sorted(got)] == [w for _, w in said]
    assert not S.is_help("how does this work", False)
    got = spark.createDataFrame([('Did “the Act” shape the U.N. and Mary Smith in the long-term?',)], "q string").select(S.trusted_targets("q")).first()[0]
    assert [t["text"] for t in got] == ["the Act", "Mary Smith"] and [t["role"] for t in got] == ["subject", "facet"]
    kinds = lambda q: [(t["text"], t["role"]) for t in S.targets_of(q)]
    assert kinds("What is the relation between Mary Smith and John Doe?") == [("Mary Smith", "subject"), ("John Doe", "facet")]
    assert kinds("Who Was Mary of Guise, and what about Article 9 or the 3rd Army?") == [("Mary of Guise", "subject"), ("Article 9", "subject"), ("3rd Army", "subject")]
    assert kinds("did a well-known plan fail? his A-12 plan") == [("A-12", "subject")] and kinds("is it so?") == []
    # the longest from the left wins, and the same name counts once
    assert kinds("Virginia Company of London or 'Virginia Company of London'") == [("Virginia Company of London", "subject")]


def test_route_traits(spark):
    said = {
        "Trace the development of the court": "broad_synthesis", "How did it change over time?": "broad_synthesis", "Who was it, and why did he go? And then?": "multi_part,premise_sensitive",
        "What is the relationship between land and law?": "relationship", "What is the relationship between land and law in the colony?": "broad_synthesis,relationship",
        "Does the book mention Mary Smith?": "absence_sensitive", "How does the book treat land?": "broad_synthesis", "Why did they leave?": "premise_sensitive",
        "How did rain relate to grain": "relationship", "What are the main causes?": "multi_part", "causes and stages": "multi_part", "How did it cause of course": "", "How did it cause war": "premise_sensitive",
        "How does the book explain the causes of war in Rome versus Athens?": "multi_part", "Who was she?": "",
    }
    q = spark.createDataFrame(list(said.items()), "q string, want string").withColumn("t", F.size(S.trusted_targets("q")) > 0)
    got = {r.q: r.traits for r in q.select("q", F.array_join(S.route_traits(F.col("q"), F.col("t")), ",").alias("traits")).collect()}
    assert got == said


def loop_gate(rows, rates, at_once):
    """Each decision from the list of admitted requests before, without any queue."""
    out, held = {}, []
    for i, client, category, at, seconds in sorted(rows, key=lambda r: (r[3], r[0])):
        near = [h for h in held if h[3] > at - 60]
        busy = [h for h in held if h[3] + h[4] > at]
        counts = [
            ("category_rate_limit", rates[0], sum(h[1] == client and h[2] == category for h in near)), ("client_rate_limit", rates[1], sum(h[1] == client for h in near)), ("global_rate_limit", rates[2], len(near)),
            ("category_concurrency_limit", at_once[0], sum(h[2] == category for h in busy)), ("client_concurrency_limit", at_once[1], sum(h[1] == client for h in busy)), ("global_concurrency_limit", at_once[2], len(busy)),
        ]
        out[i] = next((n for n, limit, k in counts if limit is not None and k >= limit), "admitted")
        if out[i] == "admitted":
            held.append((i, client, category, at, seconds))
    return out


def test_gate_against_loop(spark):
    rnd = random.Random(8)
    for rates, at_once in (((2, 4, 9), (3, 2, 5)), ((None, 3, None), (None, None, 2))):
        rows = [(i, rnd.choice("abc"), rnd.choice("xy"), float(rnd.randint(0, 300)), float(rnd.randint(0, 40))) for i in range(200)]
        df = spark.createDataFrame([(1, *r) for r in rows], "instance int, id long, client string, category string, at double, seconds double")
        got = {r.id: r.decision for r in S.rate_gate(df, rates, at_once).collect()}
        assert got == loop_gate(rows, rates, at_once)
        assert len(set(got.values())) >= 3


def test_budget_admission_against_loop(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), i // 2, None if rnd.random() < 0.1 else rnd.randint(0, 40)) for i in range(120)]
    got = {r.id: (r.admitted, r.spent) for r in S.admit_within(spark.createDataFrame([(i, k, t, None if c is None else float(c)) for i, k, t, c in rows], "id long, key string, at long, cost double"), 300).collect()}
    spent: dict = {}
    for i, k, _, c in rows:
        ok = c is not None and spent.get(k, 0) + c <= 300
        spent[k] = spent.get(k, 0) + (c if ok else 0)
        assert got[i] == (ok, spent[k])


def loop_allocate(lanes, limit, prefer_new):
    """Choices one after the other, each from scratch. lanes: facet -> candidates (chunk, document, score) in order."""
    order, shared = [], {}
    for f, cs in lanes.items():
        if cs[0][0] in order:
            shared.setdefault(f, []).append(cs[0][0])
            continue
        free = [c for c in cs if c[0] not in order]
        if len(order) < limit and free:
            docs = {d for g in lanes.values() for c, d, _ in g if c in order}
            new = [c for c in free if c[1] not in docs and (free[0][2] <= 0 or c[2] >= 0.75 * free[0][2])] if prefer_new else []
            pick = (new or free)[0][0]
            order.append(pick)
            shared.setdefault(f, []).append(pick)
    place = dict.fromkeys(lanes, 0)
    while len(order) < limit and any(place[f] < len(cs) for f, cs in lanes.items()):
        for f, cs in lanes.items():
            while place[f] < len(cs) and len(order) < limit:
                c = cs[place[f]][0]
                place[f] += 1
                if c not in shared.setdefault(f, []):
                    shared[f].append(c)
                if c not in order:
                    order.append(c)
                    break
    return {(f, c): order.index(c) + 1 for f, cs in shared.items() for c in cs}


def test_allocation_against_loop(spark):
    rnd, rows, want = random.Random(11), [], {False: {}, True: {}}
    for q in range(60):
        lanes = {}
        for k in range(rnd.randint(1, 4)):
            ids = rnd.sample(range(12), rnd.randint(1, 6))
            score = sorted((rnd.choice([0.0, 1.0, 2.0, 2.5, 3.0]) for _ in ids), reverse=True)
            lanes[f"F{k}"] = [(f"c{i:02}", f"d{i % 4}", s) for i, s in zip(ids, score)]
            rows += [(q, f"F{k}", k + 1, f"c{i:02}", f"d{i % 4}", s, r) for r, (i, s) in enumerate(zip(ids, score), 1)]
        for new in want:
            want[new].update({(q, *k): n for k, n in loop_allocate(lanes, 6, new).items()})
    df = spark.createDataFrame(rows, "query_id long, facet_id string, lane int, chunk_id string, document string, score double, rank int")
    for new in want:
        got = {(r.query_id, r.facet_id, r.chunk_id): r.source_number for r in A.allocate(df, 6, new).collect()}
        assert got == want[new]
    one_left = A.remapped(A.allocate(df, 6), df.filter("chunk_id > 'c03'"))
    for q, part in {r.query_id: [x for x in one_left.collect() if x.query_id == r.query_id] for r in one_left.select("query_id").distinct().limit(5).collect()}.items():
        assert sorted({r.source_number for r in part}) == list(range(1, len({r.chunk_id for r in part}) + 1))


def test_promotion_against_loop(spark):
    rnd = random.Random(31)
    document = lambda c: f"d{int(c[1:]) % 4}"
    context, facets, anchors, want = [], [], [], {}
    for q in range(80):
        old = [f"c{i:02}" for i in rnd.sample(range(14), rnd.randint(1, 6))]
        lanes = {f"F{k}": rnd.sample(old, rnd.randint(1, len(old))) for k in range(1, rnd.randint(1, 5))}
        asked = [f"c{i:02}" for i in rnd.sample(range(14), rnd.randint(0, 4))]
        context += [(q, c, document(c), i) for i, c in enumerate(old, 1)]
        facets += [(q, f, c, document(c), old.index(c) + 1) for f, cs in lanes.items() for c in cs]
        anchors += [(q, c, document(c), i) for i, c in enumerate(asked)]
        guarded: list = []
        for f in sorted(lanes):
            free = [c for c in sorted(lanes[f], key=old.index) if c not in guarded]
            guarded += free[:1]
        admitted: list = []
        for c in asked:
            if c in guarded or len(guarded) + sum(x not in guarded for x in admitted) < 6:
                admitted.append(c)
        new = list(dict.fromkeys(admitted + guarded))
        seen, late = {document(c) for c in new}, []
        for c in old:
            if c not in new:
                (late if document(c) in seen else new).append(c)
                seen.add(document(c))
        for i, c in enumerate((new + late)[:6] if asked else old, 1):
            want[q, i] = (c, "retrieval" if c in old else "corpus_anchor", c in guarded)
    kinds = "query_id long, chunk_id string, document string, source_number int", "query_id long, facet_id string, chunk_id string, document string, source_number int", "query_id long, chunk_id string, document string, place int"
    got = A.promote(*(spark.createDataFrame(r, k) for r, k in zip((context, facets, anchors), kinds)), 6).collect()
    assert {(r.query_id, r.source_number): (r.chunk_id, r.origin, r.protected) for r in got} == want


def test_role_profiles_against_loop(spark):
    rnd = random.Random(13)
    pool = ["Council", "council", "NATO", "Mary", "smith", "1607", "1984", "counsel", "river", "The", "A1", "land", "Éclair", "x"]
    docs = [(f"d{i % 5}", rnd.choice(pool), " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60)))) for i in range(25)]
    got = {r.document: r.terms for r in A.role_profiles(spark.createDataFrame(docs, "document string, title string, text string"), ("the",), ("council",)).collect()}
    fold = lambda w: "eclair" if w == "Éclair" else w.lower()
    ok = lambda w: len(w) >= 2 and fold(w) != "the"
    n: dict = {d: {} for d, _, _ in docs}
    named, acronym, titles = ({d: {} for d in n} for _ in range(3))
    for d, title, text in docs:
        titles[d] |= {fold(title): 1} if ok(title) else {}
        for w in filter(ok, text.split()):
            for table, yes in ((n, True), (named, w[0].isupper()), (acronym, w.isupper() and not w.isdigit() or w.isdigit())):
                if yes:
                    table[d][fold(w)] = table[d].get(fold(w), 0) + 1
    for d in n:
        year = lambda w: w in ("1607", "1984")
        df = {w: sum(w in n[x] for x in n) for w in n[d]}
        score = {w: round((1 + math.log(k)) * (math.log(6 / (df[w] + 1)) + 1) + (1.5 if w in titles[d] else 0), 9) for w, k in n[d].items() if not year(w)}
        rank = lambda ws, by: sorted(ws, key=lambda w: (-score.get(w, 1.5 if w in titles[d] and not year(w) else 0.0), -by.get(w, 0), w))  # noqa: B023, E731
        periods = sorted((w for w in n[d] if year(w)), key=lambda w: (-n[d][w], w))[:4]
        out: list = []
        lists = ((rank([w for w in titles[d] if not year(w)], n[d]), 4), (rank(acronym[d], acronym[d]), 6), (rank(named[d], named[d]), 18), (rank([w for w in score if w == "council"], n[d]), 16), (rank(score, n[d]), 48), (periods, 4))
        for ws, limit in lists:
            out += [w for w in ws if w not in out][:limit]
        assert got[d] == out, d


def test_apportion_against_loop(spark):
    rnd, rows, want = random.Random(6), [], {}
    for q in range(40):
        lengths = [rnd.randint(1, 9) for _ in range(rnd.randint(1, 5))]
        rows += [(q, i, n) for i, n in enumerate(lengths)]
        k = [1] * len(lengths)
        while sum(k) < 10 and any(a < b for a, b in zip(k, lengths)):
            i = max((i for i in range(len(k)) if k[i] < lengths[i]), key=lambda i: (lengths[i] / k[i], -i))
            k[i] += 1
        want.update({(q, i): n for i, n in enumerate(k)})
    assert {(r.query_id, r.source): r.scopes for r in S.apportion(spark.createDataFrame(rows, "query_id long, source int, length int"), 10).collect()} == want


def test_near_questions_against_all_pairs(spark):
    from difflib import SequenceMatcher

    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab cde") for _ in range(rnd.randint(10, 60))) for _ in range(25)] + ["one two three four five six seven", "xenotwothreefourfivesixseven nine"]
    edit = lambda t: "".join(c for c in t.replace("a", rnd.choice("ax")) if rnd.random() > 0.06)
    others = [edit(t) for t in texts] + [t.replace(" ", "") for t in texts]
    norm = lambda t: " ".join(t.split()).lower()
    want = set()
    for i, a in enumerate(map(norm, texts)):
        for j, b in enumerate(map(norm, others)):
            x, y = set(a.split()), set(b.split())
            tokens = len(x & y) >= 5 and round(len(x & y) / len(x | y), 9) >= 0.72
            chars = min(len(a), len(b)) >= 24 and round(SequenceMatcher(None, a, b, autojunk=False).ratio(), 9) >= 0.86
            want |= {(i, j, tokens, chars)} if tokens or chars else set()
    side = lambda rows, k: spark.createDataFrame(list(enumerate(rows)), f"{k} long, text string")
    assert {(r.a, r.b, r.by_tokens, r.by_ratio) for r in Q.near_questions(side(texts, "a"), side(others, "b")).collect()} == want and len(want) > 15


def test_shared_runs(spark):
    a = spark.createDataFrame([(1, list("abcdefgh"))], "a long, t array<string>")
    b = spark.createDataFrame([(7, list("xxcdefyyabc")), (8, list("zz"))], "b long, t array<string>")
    assert [tuple(r) for r in Q.shared_runs(a, b, 3).collect()] == [(1, 7, 4)]


def test_merge_adjacent(spark):
    r = spark.createDataFrame([(1, 0, 1, 4), (1, 0, 4, 7), (1, 0, 9, 9), (1, 1, 8, 8), (1, 0, 2, 3)], "doc_id long, chapter int, start int, end int")
    assert sorted((x.chapter, x.start, x.end, x.merged) for x in C.merge_adjacent(r).collect()) == [(0, 1, 7, 3), (0, 9, 9, 1), (1, 8, 8, 1)]


def test_rrf_promotes_agreement(spark):
    s = spark.createDataFrame([(1, c, i + 1, 0.1 * i) for i, c in enumerate("abc")], "query_id long, chunk_id string, rank int, distance double")
    x = spark.createDataFrame([(1, "c", 1, 9.0), (1, "z", 2, 8.0)], "query_id long, chunk_id string, rank int, score double")
    assert [r.chunk_id for r in R.fuse(s, x).orderBy("rank").collect()][:2] == ["c", "a"]
    assert math.isclose(R.fuse(s, x).filter("chunk_id = 'c'").first().rrf_score, round(1 / 63 + 1 / 61, 12))


def test_text_files(spark, tmp_path):
    for name, data in (("a.md", "é".encode()), ("b.md", b"\xef\xbb\xbf" + "é".encode()), ("c.md", "é".encode("utf-16")), ("d.md", b"\xe9"), ("e.md", b"\x80\xe9")):
        (tmp_path / name).write_bytes(data)
    assert [(r.document, r.text) for r in tables.text_files(spark, str(tmp_path)).orderBy("document").collect()] == [*((f"{x}.md", "é") for x in "abcd"), ("e.md", "€é")]


def test_save_never_replaces(spark, tmp_path):
    import pytest

    tables.save(spark.range(1), str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)exist"):
        tables.save(spark.range(1), str(tmp_path / "x"))


def test_docx(spark, tmp_path):
    import zipfile

    from quarry.sources import office

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    xml = f"<w:document {w}><w:body>{p('One')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('')}{p('Two')}</w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "y.txt").write_text("plain")
    assert {r.document: r.text for r in office.documents(spark, str(tmp_path)).collect()} == {"x.docx": "One\na | b\nTwo", "bad.docx": None, "y.txt": "plain"}
