"""Operators against brute force, the real tokenizer, held-out labels; the pipeline stage by stage."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from quarry.llm import contamination, lines, mixing, neardup, neighbours, passages, pii, quality, suffixes, tokens
from quarry.llm.common import table


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


def test_neighbours_recall(spark, sf):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table(spark, sf, "embeddings").collect()]
    want = brute.nearest(rows, [r for r in rows if r[0] % 100 == 0])
    got: dict = {}
    for r in neighbours.op1(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    found = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    for q in got:
        assert [s for _, s in got[q]] == sorted(s for _, s in got[q])
        assert all(abs(s - dict(want[q])[v]) < 1e-12 for v, s in got[q] if v in dict(want[q]))


def test_contamination_brute(spark, sf, docs):
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    want = brute.contaminated(docs, items)
    assert {r.doc_id: tuple(r)[1:] for r in contamination.op2(spark, sf).collect()} == want
    assert any(w[4] for w in want.values())


def test_pii_base_random():
    rnd = random.Random(3)
    for _ in range(3000):
        text = "".join(rnd.choice("a.@1 23-+()4.5 9@b.c") for _ in range(rnd.randint(0, 40)))
        b = pii.base_spans(text)
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b)
        assert (*(sum(k == i for _, k, _ in b) for i in range(4)), hashlib.sha256(joined.encode()).hexdigest()) == brute.personal_data(text)


def test_pii_long_runs_are_linear():
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "@" * 1000 + "+1" * 50_000 + "1 " * 100_000) == []


@pytest.fixture(scope="module")
def field():
    f = pii.Field()
    f.fit([s for r in pii.labelled_rows() for s in pii.sentences(*r)])
    return f


def test_field_held_out(field):
    """Secrets of sentences that it was not fitted on: exact spans."""
    right = found = planted = 0
    for text, spans in pii.labelled_rows(400, seed=77):
        base, added = pii.find_spans([text], field)[0]
        got = {(a, b) for a, k, b in added if pii.KINDS[k] == "secret"}
        want = {(a, a + len(text[a:b].rstrip(pii._TRAIL))) for a, b, k in spans if k == "secret"}
        right, found, planted = right + len(got & want), found + len(got), planted + len(want)
    assert right >= 0.97 * found and right >= 0.95 * planted > 100


def test_field_finds_secrets_without_digits_and_leaves_words_alone(field):
    rnd, letters = random.Random(8), "abcdefghijklmnopqrstuvwxyz"
    texts = [f"und der secret={''.join(rnd.choice(letters) for _ in range(n))} von" for n in range(24, 120)]
    assert sum(any(pii.KINDS[k] == "secret" for _, k, _ in added) for _, added in pii.find_spans(texts, field)) >= 0.95 * len(texts)
    plain = ["the password is required here", "Note: nothing to see", "a secret garden", "x = y and token ring", "Keys*** are### lost", "| 12 | 40 | 7 |"]
    assert all(not added for _, added in pii.find_spans(plain, field))


def test_viterbi_is_best_of_all_paths():
    rng = np.random.default_rng(3)
    n = len(pii.TAGS)
    field = pii.Field(rng.normal(size=(1 << pii.BITS, n)).astype(np.float32), rng.normal(size=(n + 1, n)).astype(np.float32), fitted=True)
    rnd = random.Random(3)
    for lanes in (7, 60):  # both forms of a step
        chains = [[rnd.choice(["Ab", "x9", "a@b.c", "wort", "4.5", "é:", "k=v"]) for _ in range(rnd.randint(1, 4))] for _ in range(lanes)]
        words, sizes = [w for c in chains for w in c], np.array([len(c) for c in chains])
        s, tags, at = field.scores(words, sizes), field.decode(words, sizes), 0
        for c in chains:
            paths = np.stack(np.meshgrid(*[np.arange(n)] * len(c), indexing="ij"), -1).reshape(-1, len(c))
            value = field.moves[n][paths[:, 0]] + sum(s[at + i][paths[:, i]] for i in range(len(c))) + sum(field.moves[paths[:, i], paths[:, i + 1]] for i in range(len(c) - 1))
            assert tuple(tags[at:at + len(c)]) == tuple(paths[value.argmax()])
            at += len(c)


def test_field_gradient():
    """Likelihood by all paths, and its gradient by differences."""
    rng, n = np.random.default_rng(5), len(pii.TAGS)
    w, moves = rng.normal(size=(6, n)) / 3, rng.normal(size=(n + 1, n)) / 3
    local, tags, real = rng.integers(0, 6, (2, 3, 4)), rng.integers(0, n, (2, 3)), np.array([[1.0, 1, 1], [1, 1, 0]])
    value, dw, dm = pii.gradient(w, moves, local, tags, real)
    every = 0.0
    for i, size in enumerate((3, 2)):
        paths = np.stack(np.meshgrid(*[np.arange(n)] * size, indexing="ij"), -1).reshape(-1, size)
        s = w[local[i]].sum(1)
        score = lambda p: moves[n][p[..., 0]] + sum(s[k][p[..., k]] for k in range(size)) + sum(moves[p[..., k], p[..., k + 1]] for k in range(size - 1))  # noqa: B023, E731
        every += score(tags[i, :size]) - np.log(np.exp(score(paths)).sum())
    assert abs(value - every) < 1e-9
    for m, d in ((w, dw), (moves, dm)):
        for at in [tuple(rng.integers(0, x) for x in m.shape) for _ in range(12)]:
            old, m[at] = m[at], m[at] + 1e-5
            up = pii.gradient(w, moves, local, tags, real)[0]
            m[at] = old - 1e-5
            down = pii.gradient(w, moves, local, tags, real)[0]
            m[at] = old
            assert abs((up - down) / 2e-5 - d[at]) < 1e-6


def test_pii_query(spark, sf, docs):
    texts = dict(docs)
    for r in pii.op3(spark, sf).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.personal_data(texts[r.doc_id])


def test_suffixes_sorted():
    rnd = random.Random(1)
    for _ in range(60):
        texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(1, 8))]
        sizes = np.array([len(t) for t in texts])
        number, length, prefix = suffixes.sorted_suffixes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)
        every = [texts[i][len(texts[i]) - n:] if n else b"" for i, n in zip(number, length)]
        assert every == sorted(every) and len(every) == sizes.sum() + len(texts)
        for a, b, p in zip(every, every[1:], prefix[1:]):
            assert a[:p] == b[:p] and (len(a) == p or len(b) == p or a[p] != b[p])


def test_suffixes_on_disk(monkeypatch):
    data, sizes = np.frombuffer(b"banananas" * 3, np.uint8), np.array([9, 9, 9])
    held = suffixes.sorted_suffixes(data, np.array([0, 9, 18]), sizes)
    monkeypatch.setattr(suffixes, "SPILL", 0)
    assert all((a == b).all() for a, b in zip(held, suffixes.sorted_suffixes(data, np.array([0, 9, 18]), sizes)))


def test_passages_brute(spark, sf, docs):
    want = brute.repeats(docs)
    assert {r.doc_id: tuple(r)[1:] for r in passages.op5(spark, sf).collect()} == want
    assert sum(w[1] for w in want.values()) > 0


def test_passages_small_alphabet(spark):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 260)))) for i in range(30)] + [(40, "ab" * 400), (41, "ab" * 300 + "c")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), size=16).collect()}
    assert got == brute.repeats(rows, 16)


def test_tokens_random():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    real, mine = Tokenizer.from_file(path), tokens.Counter(tokens.read_vocabulary(path))
    rnd = random.Random(1)
    parts = ["'", "'s", "'re", "'ve", "'ll", "r", "e", "l", " ", "  ", "\n", "\t", " ", "é", "1", "²", "!", "a", "日本", "😀", "　", "'R", "<|endoftext|>", "<|", "\r\n", "́", "the", "tion"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + ["a" * 3000, " " * 2000 + "x"]
    assert mine.count(texts) == [len(e.ids) for e in real.encode_batch(texts, add_special_tokens=False)]


def test_tokens_of_one_long_piece():
    """A run of letters without any blank: exact, and in time that grows with its length, not its square."""
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    real, mine = Tokenizer.from_file(path), tokens.Counter(tokens.read_vocabulary(path))
    rnd, took = random.Random(2), []
    for n in (100_000, 800_000):
        text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.process_time()
        count = mine.count([text])
        took.append(time.process_time() - began)
        assert count == [len(real.encode(text, add_special_tokens=False).ids)]
    assert took[1] < 24 * took[0]


def test_tokens_maps_compose():
    """Cut anywhere, the chunks' maps give the count of the whole, also where the tables are full and start anew."""
    import public_tokenizers

    mine = tokens.Counter(tokens.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))).merges
    rnd = random.Random(4)
    for room in (1_000_000, 40):
        mine.room = room
        for _ in range(300):
            data = "".join(rnd.choice("etaoin shr") for _ in range(rnd.randint(1, 40))).encode()
            state = total = 0
            for chunk in (data[:(k := rnd.randint(0, len(data)))], data[k:]):
                state, gained = mine.run(state, chunk)
                total += gained
            assert total == len(mine.merge(data))


def test_tokens_query(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: (len(t.encode()), n := len(real.encode(t, add_special_tokens=False).ids), n > 1024) for d, t in docs}
    assert {r.doc_id: tuple(r)[1:] for r in tokens.op6(spark, sf).collect()} == want


def near_brute(docs):
    sets = {d: s for d, t in docs if (w := (t or "").lower().split()) and (s := {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})}
    label = {d: d for d, _ in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if 100 * (n := len(sets[a] & sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return {d: (len(sets.get(d, ())), label[d], label[d] == d) for d, _ in docs}


def test_near_duplicates_brute(spark, sf, docs):
    ascii_only = [(d, "".join(c.lower() if c.isascii() else c for c in t)) for d, t in docs]
    sets = near_brute([(d, t) for d, t in ascii_only])
    got = {r.doc_id: tuple(r)[1:] for r in neardup.near_duplicates(spark.createDataFrame(ascii_only, "doc_id long, text string")).collect()}
    assert got == sets


def test_near_duplicates_chain_in_blocks(spark):
    """A chain of texts, each near the next only, dealt over several blocks, with copies."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(24):
        words = base.copy()
        words[: 3 * i] = [f"x{k}" for k in range(3 * i)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=4000).collect()}
    assert {d: c for d, (_, c, _) in near_brute(rows).items()} == got


def test_estimates_near_truth():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.85):
        both = rng.integers(0, 1 << 62, 2000).astype(np.uint64)
        n = int(2000 * (1 / share - 1) / 2)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 62, n).astype(np.uint64)])) for _ in range(2))
        x, y = neardup.sketch(a), neardup.sketch(b)
        # the sketch of a union is the maximum of the sketches
        assert (neardup.sketch(np.union1d(a, b)) == np.maximum(x, y)).all()
        e = neardup.estimates(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(e - share) < 0.15


def test_mix_meets_budget(spark, sf):
    d = table(spark, sf, "documents")
    have = {r.source: r.n for r in d.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    budget = 3 * sum(have.values())
    got = mixing.mix(d, carry=["doc_id", "source"], budget=budget, repeat_limit=4.0, target_entropy=0.0 + 10, block_tokens=500).collect()
    drawn: dict = {}
    for r in got:
        drawn[r.source] = drawn.get(r.source, 0) + r.mix_tokens
    assert len({(r.doc_id, r.mix_epoch) for r in got}) == len(got)
    # the most repeated source is at its limit, no weight is exceeded, and little is left over
    assert max(drawn[s] / have[s] for s in have) <= 4.0 + 1e-9
    assert 0.9 * budget <= sum(drawn.values()) <= budget


def spark_hash(*values):
    """Spark's xxhash64: int and long as 4 and 8 bytes, text as UTF-8; nulls are passed over."""
    h = 42
    for kind, v in values:
        if v is not None:
            data = v.encode() if kind == "s" else int(v).to_bytes(4 if kind == "i" else 8, "little", signed=True)
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def mix_brute(rows, budget, goal, limit, block_tokens, seed=17):
    """Draws (doc_id, source, tokens, epoch, block, key) by plain loops. rows: doc_id, text, source."""
    docs = [(d, t, s, len(re.findall(r"[^ \t\n\x0b\f\r]+", t or ""))) for d, t, s in rows]
    docs = [(d, s, n, spark_hash(("i", seed), ("l", d), ("s", t)), "n" if s is None else "s" + s) for d, t, s, n in docs if n]
    have: dict = {}
    for *_, n, _, src in docs:
        have[src] = have.get(src, 0) + n
    total = sum(have.values())
    p = np.array([have[s] / total for s in sorted(have)])
    goal = -(p * np.log(p)).sum() + 0.5 * (np.log(len(p)) + (p * np.log(p)).sum()) if goal is None else goal

    def fits(i):
        w = p ** (i / 2 ** 25)
        w /= w.sum()
        return -(w * np.log(w)).sum() <= goal + 1e-12 and (budget * w / (p * total)).max() <= limit * (1 + 1e-12)

    low, high = -1, 1 << 25
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    w = p ** (high / 2 ** 25)
    out = []
    for src, share in zip(sorted(have), w / w.sum(), strict=True):
        quota = int(budget * share + 1e-6)
        full, left = divmod(quota, have[src])
        blocks: dict = {}
        for d in docs:
            if d[4] == src:
                blocks.setdefault(d[3] % -(-have[src] // block_tokens), []).append(d)
        turn = sorted(blocks, key=lambda b: ((spark_hash(("i", seed), ("i", full), ("s", src), ("l", b)) & (1 << 64) - 1) >> 1, b))
        for place, b in enumerate(turn, 1):
            size = sum(d[2] for d in blocks[b])
            for e in range(full):
                block = spark_hash(("i", seed), ("i", e), ("s", src), ("l", b)) % (1 << 40)
                out += [(*d[:3], e, block, d[3]) for d in blocks[b]]
            run = 0
            for d in sorted(blocks[b], key=lambda d: (d[3], d[0], d[2])):
                run += d[2]
                if run <= left:
                    out.append((*d[:3], full, place, d[3]))
            left = max(0, left - size)
    return sorted(out, key=str)


@pytest.mark.parametrize("times,goal,limit,block,part", [(1, None, 4.0, 250_000, 1024), (2.7, None, 6.0, 400, 3), (0.3, 10.0, 4.0, 150, 1), (3, 10.0, 4.0, 900, 2)])
def test_mix_brute(spark, sf, times, goal, limit, block, part):
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    d = d.unionByName(spark.createDataFrame([(5_000 + i, f"a few words {i} {'more ' * i}", None) for i in range(30)] + [(6_000, None, "x"), (6_001, " ", "x")], d.schema))
    rows = [tuple(r) for r in d.collect()]
    total = sum(len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")) for _, t, _ in rows)
    got = mixing.mix(d, carry=["doc_id", "source"], budget=int(times * total), target_entropy=goal, repeat_limit=limit, block_tokens=block, part_blocks=part).collect()
    want = mix_brute(rows, int(times * total), goal, limit, block)
    assert sorted(((r.doc_id, r.source, r.mix_tokens, r.mix_epoch, r.mix_block, r.mix_order) for r in got), key=str) == want
    assert len({w[1] for w in want}) > 2


def test_alpha_bisection(spark):
    s = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "__src string, __n long")
    alpha, z = mixing.solve_alpha(s, 1000, 1000, 0.8, 100.0)
    p = np.array([0.9, 0.09, 0.01]) ** alpha
    w = p / p.sum()
    assert abs(-(w * np.log(w)).sum() - 0.8) < 1e-5 and abs(p.sum() - z) < 1e-9
    alpha, _ = mixing.solve_alpha(s, 1000, 1000, 10.0, 5.0)
    p = np.array([0.9, 0.09, 0.01]) ** alpha
    assert abs((p / p.sum()).max() - 0) > 0 and abs((p / p.sum())[2] / 0.01 - 5) < 1e-3
    with pytest.raises(ValueError):
        mixing.solve_alpha(s, 10_000, 1000, 0.8, 2.0)


def test_quality_gradient():
    """Likelihood of the grades by their definition, its gradient by differences, and a fit that reaches the top."""
    rng = np.random.default_rng(2)
    n, words = 40, 5
    row, flat = np.repeat(np.arange(n), 3), rng.integers(0, words, 3 * n)
    x, grades = rng.normal(size=(n, 2)), rng.integers(0, quality.GRADES, n)
    p = rng.normal(size=words + 2 + quality.GRADES - 1) / 2

    def likelihood(p):
        cuts = [p[-2], p[-2] + np.exp(p[-1])]
        total = 0.0
        for i in range(n):
            s = sum(p[w] for w in flat[row == i]) + x[i] @ p[words:words + 2]
            at_most = [0.0, *(1 / (1 + np.exp(s - c)) for c in cuts), 1.0]
            total += np.log(at_most[grades[i] + 1] - at_most[grades[i]])
        return total / n

    value, g = quality.gradient(p, flat, row, x, grades)
    assert abs(value - likelihood(p)) < 1e-9
    for k in range(len(p)):
        step = np.eye(len(p))[k] * 1e-6
        assert abs((likelihood(p + step) - likelihood(p - step)) / 2e-6 - g[k]) < 1e-6
    ids = [np.unique(flat[row == i]).astype(np.int32) for i in range(n)]
    model = quality.fit(ids, x, grades, ridge=0.0, least_docs=1, rounds=1500)
    used = np.concatenate([model.words[:words].astype(float), model.stats, [model.cuts[0], np.log(model.cuts[1] - model.cuts[0])]])
    _, g = quality.gradient(used, np.concatenate(ids), np.repeat(np.arange(n), [len(i) for i in ids]), (x - model.mean) / model.scale, grades)
    assert np.abs(g).max() < 1e-3


def test_quality_query_by_hand(spark, sf):
    """The query's columns from the model's parameters, by their definition, for every document."""
    d = table(spark, sf, "documents")
    model = quality.train(d, table(spark, sf, "labels"))
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in quality.op9(spark, sf).collect():
        ids, stats = quality.features(texts[r.doc_id])
        s = sum(float(model.words[i]) for i in ids) + float((((stats - model.mean) / model.scale) * model.stats).sum())
        tails = [1 / (1 + np.exp(c - s)) for c in model.cuts]
        assert abs(r.expected_grade - sum(tails)) < 2e-5 and abs(r.tail - tails[-1]) < 2e-5
        assert r.kept == (tails[-1] >= 0.5) or abs(tails[-1] - 0.5) < 1e-5


def test_quality_held_out(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    g = {r.doc_id: r.grade for r in quality.graded(table(spark, "/root/testdata/sf0.01", "labels")).collect()}
    rows = sorted(((r.doc_id, r.text) for r in d.collect() if r.doc_id in g), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())
    f = [quality.features(t) for _, t in rows]
    y = np.array([g[i] for i, _ in rows])
    model = quality.fit([a for a, _ in f[:300]], np.array([b for _, b in f[:300]]), y[:300])
    assert model.cuts[0] < model.cuts[1]
    kept = model.tails(np.array([model.score(*x) for x in f[300:]]))[:, -1] >= 0.5
    assert kept[y[300:] == 2].mean() >= 0.95 and kept[y[300:] < 2].mean() <= 0.5


def lines_brute(docs, min_words=10):
    """Texts without all lines of runs of min_words words or more that begin earlier too, run by run; of a run's lines
    each lies in one of at most min_words lines."""
    seen, gone = set(), {d: set() for d, _ in docs}
    for d, t in sorted(docs):
        rows = [(i, s) for i, raw in enumerate((t or "").split("\n")) if (s := raw.strip(" \t\r\f\v"))]
        for a in range(len(rows)):
            for b in range(a + 1, min(len(rows), a + min_words) + 1):
                run = tuple(s for _, s in rows[a:b])
                if sum(len(s.split()) for s in run) >= min_words:
                    if run in seen:
                        gone[d] |= {i for i, _ in rows[a:b]}
                    seen.add(run)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def test_lines_brute(spark, docs):
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == lines_brute(docs)


def test_pipeline_stages(spark, sf):
    d = table(spark, sf, "documents")
    keep = lambda df: {r.doc_id: r.text for r in df.collect()}
    fit = quality.train(d, table(spark, sf, "labels"))
    one = corpus_pipeline.quality(spark, d, sf)
    assert one.columns == d.columns
    assert keep(one) == {i: t for i, t in keep(d).items() if fit.tails(np.array([fit.score(*quality.features(t))]))[0, -1] >= 0.5}
    two = corpus_pipeline.lines(spark, one, sf).cache()
    left = lines_brute(list(keep(one).items()))
    assert two.columns == d.columns and keep(two) == {i: t for i, t in left.items() if t == keep(one)[i] or t.strip()}
    assert two.filter("n_chars <> length(text)").count() == 0
    three = corpus_pipeline.near_copies(spark, two, sf).cache()
    low = [(i, "".join(c.lower() if c.isascii() else c for c in t)) for i, t in keep(two).items()]
    assert set(keep(three)) == {i for i, (_, _, k) in near_brute(low).items() if k}
    four = corpus_pipeline.decontaminate(spark, three, sf).cache()
    hit = brute.contaminated(list(keep(three).items()), [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])
    assert set(keep(four)) == {i for i, h in hit.items() if not h[4]}
    five = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in five} <= set(keep(four)) and len(five) > 0
