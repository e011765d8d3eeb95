"""op5: fragments that only share their anchor by chance stay behind; those that share a window never do."""

import random

import numpy as np

from quarry.llm import passages as P


def _alike(texts, size):
    data, ends = P._joined(texts)
    anchor, owner, start, runs, left, right = P.fragments(data, ends, size, P.Hot([]))
    return P.alike(owner, anchor.astype(np.uint32), left, right), owner, start, runs, ends


def test_chance_anchors_stay_behind():
    rnd = random.Random(7)
    word = lambda n: bytes(rnd.randrange(97, 123) for _ in range(n))
    common = [word(20) for _ in range(50)]
    texts = [b"".join(word(60) + c for c in common) + word(60) for _ in range(6)]
    some, *_ = _alike(texts, 50)
    assert len(some) == 0


def test_no_common_window_is_lost():
    rnd = random.Random(8)
    for case in range(60):
        size, letters = rnd.choice([16, 17, 18, 33, 50, 51, 200]), rnd.choice([b"a", b"ab", b"abcdefgh"])
        texts = [bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 400))) for _ in range(4)]
        for _ in range(4):
            a = rnd.randrange(4)
            i = rnd.randint(0, 300)
            j, n = rnd.randrange(4), rnd.randint(0, 2 * size)
            texts[j] = texts[j][:rnd.randint(0, 200)] + texts[a][i:i + n] + texts[j][200:]
        some, owner, start, runs, ends = _alike(texts, size)
        begin = np.append(0, ends[:-1])
        kept = {(int(owner[f]), int(start[f] - begin[owner[f]]) + w) for f in some.tolist() for w in range(int(runs[f]))}
        held = [{t[i:i + size] for i in range(len(t) - size + 1)} for t in texts]
        for d, t in enumerate(texts):
            for i in range(len(t) - size + 1):
                if any(t[i:i + size] in h for e, h in enumerate(held) if e != d):
                    assert (d, i) in kept, (case, size, d, i)
