"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from quarry.llm import contamination as C
from quarry.llm import lines as L
from quarry.llm import mixing as M
from quarry.llm import neardup as N
from quarry.llm import neighbours as V
from quarry.llm import passages as P
from quarry.llm import pii, preference, quality, tokens

KIND = "doc_id long, text string, source string, found string, pii int, kept int, n_tokens int, N_Lines int, mix_epoch int, `__tok` int, blob string, rank int"
LONG = "wort " * 40_000 + "ende"
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog and runs far away today", "a"), (1, None, "a"), (2, "", None), (3, "   \n\t ", "b"), (4, LONG, "b"),
    (5, "The quick brown fox jumps over the lazy dog and runs far away today", "a"), (5, "The quick brown fox jumps over the lazy dog and runs far away today", "a"),
    (None, "The quick brown fox jumps over the lazy dog and runs far away today", None), (None, None, None), (6, "é😀", "c"), (7, "one\ntwo\r\n\nthree", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, "x", 1, 2, 3, 4, 5, 6, "y", 7) for t in TEXTS], KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_contamination(spark, docs, none):
    items = spark.createDataFrame([(1, "Quick BROWN fox jumps over the lazy dog, and runs far"), (2, None), (None, "the"), (3, ""), (4, "two\n\nthree"), (4, "two three"), (1, "Quick BROWN fox jumps over the lazy dog, and runs far")], "item_id long, text string")
    found = C.contamination(docs, items)
    got = sorted_rows(found.select("doc_id", "found.n_words", "found.n_hit", "found.items"))
    want = sorted(((d, *C_brute(t, items)) for d, t, _ in TEXTS), key=str)
    assert got == want
    assert found.columns.count("found") == 1 and "rank" in found.columns
    assert C.contamination(none, items).count() == 0
    assert C.contamination(docs, items.limit(0)).agg(F.sum("found.n_hit")).first()[0] == 0
    # shards give the same
    assert sorted_rows(C.contamination(docs, items, shard_bytes=20).select("doc_id", "found.n_words", "found.n_hit", "found.items")) == want


def C_brute(text, items):
    out = brute.contaminated([(0, text)], [tuple(r) for r in items.collect()])[0]
    found = [i for i in ("1", "4") if brute.contaminated([(0, text)], [tuple(r) for r in items.collect() if str(r[0]) == i])[0][4]]
    return out[0], out[1], found


def test_contamination_offsets(spark):
    docs = spark.createDataFrame([(1, "Ünd: Das-ist ÉIN test. Rest")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "das ist Éin TEST")], "item_id long, text string")
    row = C.hit_spans(C.contamination(docs, items)).first()
    assert [row.text[s.start:s.end] for s in row.spans] == ["Das-ist ÉIN test"]


@pytest.fixture(scope="module")
def field():
    f = pii.Field()
    f.fit([s for r in pii.labelled_rows(300) for s in pii.sentences(*r)])
    return f


def test_pii(docs, none, field):
    found = pii.personal_data(docs, field)
    assert found.count() == len(TEXTS) and found.filter("size(pii) > 0").count() == 0
    assert pii.personal_data(none, field).count() == 0
    assert pii.personal_data(docs, pii.Field()).count() == len(TEXTS)


def test_pii_in_nulls_repeats_long_texts_and_clashes(spark, field):
    """Each row gets its own spans, also behind a very long line, and other columns stay."""
    long = "wort " * 300_000
    said = "Mail a.b@c.org, token = \"0123456789abcdef0123456789abcdef01234567\" from 10.0.0.1 or 4111 1111 1111 1111; +1 (555) 555-0100."
    rows = [(1, said), (1, said), (None, said), (2, long + said), (3, None), (4, "é😀\n" + said), (5, long.replace(" ", "x") + " b@c.de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'p' as pii", "1 as n_email", "2 as base")
    got = pii.personal_data(docs, field).collect()
    cut = [(r.doc_id, [(s.kind, r.text[s.start:s.end], s.base) for s in r.pii]) for r in got]
    whole = [("email", "a.b@c.org", True), ("secret", 'token = "0123456789abcdef0123456789abcdef01234567', False), ("ip", "10.0.0.1", True), ("card", "4111 1111 1111 1111", True), ("phone", "+1 (555) 555-0100", True)]
    assert sorted(cut, key=str) == sorted([(1, whole), (1, whole), (None, whole), (2, whole), (3, []), (4, whole), (5, [("email", "b@c.de", True)])], key=str)
    assert all(r.n_email == 1 and r.base == 2 for r in got)
    marked = {r.doc_id: r.text for r in pii.masked(pii.personal_data(docs, field)).filter("doc_id in (3, 4)").collect()}
    assert marked == {3: None, 4: 'é😀\nMail <EMAIL>, <SECRET>" from <IP> or <CARD>; <PHONE>.'}


def test_tokens(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    real = Tokenizer.from_file(path)
    got = sorted_rows(tokens.token_counts(docs, path).select("doc_id", "n_bytes", "n_tokens"))
    assert got == sorted(((d, len((t or "").encode()), len(real.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in TEXTS), key=str)
    assert tokens.token_counts(none, path).count() == 0


def test_near_duplicates(docs, none):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in N.near_duplicates(docs).collect()}
    assert got[0, 10] == (0, True) and got[5, 10] == (0, False) and got[None, 10] == (None, True) and got[None, 0] == (None, True)
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True) and got[3, 0] == (3, True) and got[4, 2] == (4, True) and got[7, 1] == (7, True)
    assert N.near_duplicates(docs).count() == len(TEXTS)
    assert N.near_duplicates(none).count() == 0


def test_passages(docs, none):
    got = sorted_rows(P.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans")))
    want = []
    for d, t, _ in TEXTS:
        n = len((t or "").encode())
        want.append((d, n, n if d == 5 else 0, int(d == 5)))
    assert got == sorted(want, key=str)
    assert P.remove_repeats(none).count() == 0


def test_lines(docs, none, spark):
    got = L.dedup_lines(docs)
    assert "N_Lines" not in got.columns and "found" in got.columns and got.count() == len(TEXTS)
    by = {(r.doc_id, r.text): r.n_lines_removed for r in got.collect()}
    assert by[5, ""] == 1 and by[0, ""] == 1 and by[None, TEXTS[0][1]] == 0  # null comes first in the order
    assert by[1, None] == 0 and by[7, TEXTS[-1][1]] == 0
    assert L.dedup_lines(none).count() == 0


def test_mix(docs, none):
    got = M.mix(docs, repeat_limit=50)
    assert set(got.columns) >= {"doc_id", "blob", "mix_epoch", "mix_tokens"} and "__tok" not in got.columns
    assert got.filter("mix_tokens = 0 or text is null").count() == 0
    assert M.mix(none).count() == 0


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (4, 0, 0), (6, None, None), (None, 1, 0), (7, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert quality.classify(docs, model).count() == len(TEXTS)
    assert quality.classify(docs, quality.train(docs, labels.limit(0))).filter("kept and tail is null").count() == len(TEXTS)
    assert quality.classify(none, model).count() == 0
    assert sorted_rows(quality.graded(labels)) == [(0, 2), (4, 1), (7, 0)]


TURNS = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "c"), (1, 2, None, None), (2, 0, "user", None), (None, 0, "user", "a"), (4, 0, "user", "q"), (4, 0, "user", "q"), (5, 0, "user", "q")]
KEYS = [(0, 0, 1), (1, 2, None), (2, 4, 5)]


def test_preference(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    for name in ("pair_id", "c", "r", "t", "side", "prompt", "n_common", "__x"):
        turns = turns.withColumn(name, F.lit(7))
    pairs = spark.createDataFrame(KEYS, "pair_id long, chosen_id long, rejected_id long")
    got = {r.pair_id: r for r in preference.preference_pairs(turns, pairs).collect()}
    assert sorted(got) == [0, 1, 2]
    assert got[0].prompt == "<|user|>\na<|end|>\n" and got[0].chosen == "<|assistant|>\nb<|end|>\n" and got[0].n_common == 1
    assert [got[0].chosen[s.start:s.end] for s in got[0].chosen_mask] == ["b<|end|>\n"]
    assert got[0].rejected.endswith("<||>\n<|end|>\n")
    assert got[1].rejected_id is None and got[1].prompt == "" and got[1].rejected == "" and got[1].chosen == "<|user|>\n<|end|>\n"
    assert got[2].n_common == 1 and got[2].chosen == "<|user|>\nq<|end|>\n" and got[2].rejected == ""
    assert preference.preference_pairs(turns.limit(0), pairs.limit(0)).count() == 0
    assert preference.preference_pairs(*preference.reply_pairs(turns.limit(0))).count() == 0
    # 2k + 1 as the table's own variant: the chosen one's turns before its last reply, then the other's last reply
    own = {r.pair_id: r for r in preference.preference_pairs(*preference.reply_pairs(turns)).collect()}
    assert own[0].n_common == 1 and own[0].rejected == "<|assistant|>\nc<|end|>\n<||>\n<|end|>\n"
    assert own[1].n_common == 0 and own[1].chosen == "<|user|>\n<|end|>\n" and own[1].rejected == ""
    # no reply in either: all of the first, then nothing of the second
    assert own[2].n_common == 2 and own[2].chosen == "" and own[2].rejected == ""


def test_preference_random_conversations(spark):
    """By plain loops, with shared beginnings of every length, ties, nulls and a very long turn."""
    rnd = random.Random(9)
    long = "wort " * 100_000
    pool = [("user", "a"), ("assistant", "b"), ("assistant", None), (None, "c"), ("user", ""), ("assistant", long)]
    turns, pairs, want = [], [], {}
    for p in range(60):
        first = [rnd.choice(pool) for _ in range(rnd.randint(0, 6))]
        cut = rnd.randint(0, len(first))
        second = first[:cut] + [rnd.choice(pool) for _ in range(rnd.randint(0, 3))]
        for conv, of in ((2 * p, first), (2 * p + 1, second)):
            turns += [(conv, i, *x) for i, x in enumerate(of)]
        n = 0
        while n < min(len(first), len(second)) and first[n] == second[n]:
            n += 1
        text = lambda part: "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in part)
        kept = lambda part: [(t or "") + "<|end|>\n" for r, t in part if r == "assistant"]
        pairs.append((p, 2 * p, 2 * p + 1))
        want[p] = (n, text(first[:n]), text(first[n:]), kept(first[n:]), text(second[n:]), kept(second[n:]))
    rnd.shuffle(turns)
    got = preference.preference_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), spark.createDataFrame(pairs, "pair_id long, chosen_id long, rejected_id long"))
    assert {r.pair_id: (r.n_common, r.prompt, r.chosen, [r.chosen[s.start:s.end] for s in r.chosen_mask], r.rejected, [r.rejected[s.start:s.end] for s in r.rejected_mask]) for r in got.collect()} == want
    assert any(w[0] > 1 for w in want.values())


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(100, [1.0, 1.0]), (101, [1.0, 1.0]), (102, None), (103, [0.0, 0.0]), (104, [1.0, None]), (105, [nan, 1.0]), (106, [inf, 1.0]), (107, [1.0]), (None, [1.0, 2.0]), (100, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = [tuple(r) for r in V.search(v, v.filter("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(100, 1, 1, 0.0), (100, 2, 101, 0.0), (100, 3, 2, 1.0)]
    assert V.search(v.limit(0), v.limit(0)).count() == 0
    few = v.filter("vec_id in (1, 100)")
    assert V.search(few, few.filter("vec_id = 100")).count() == 1


def test_neighbours_far_queries_get_all_their_rows(spark):
    """A query far from all others, whose own list holds hardly any row, and fewer candidates than asked for."""
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) + 50 * (i % 20) for _ in range(8)]) for i in range(1, 700)] + [(1000, [9e5] * 8), (1100, [-9e5] * 8)]
    got: dict = {}
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in V.search(v, v.filter("vec_id % 100 = 0"), k=10).collect():
        got.setdefault(r.query_id, []).append(r.rank)
    assert {q: sorted(r) for q, r in got.items()} == {q: list(range(1, 11)) for q in (100, 200, 300, 400, 500, 600, 1000, 1100)}
    few = v.filter("vec_id <= 6 or vec_id = 100")
    assert V.search(few, few.filter("vec_id = 100"), k=10).count() == 6
