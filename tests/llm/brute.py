"""Contracts by plain loops, to hold the operators against."""

import hashlib
import re

import numpy as np

from quarry.llm.pii import luhn


def personal_data(text: str | None) -> tuple[int, int, int, int, str]:
    """The base contract by its patterns as they stand, for tests."""
    text = text or ""
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    spans = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(tests.items()) for m in re.finditer(p, text) if ok(m[0])]
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    return (*(sum(x[3] == k for x in spans) for k in tests), hashlib.sha256(joined.encode()).hexdigest())


def repeats(docs: list[tuple[int, str | None]], size: int = 50) -> dict[int, tuple[int, int, int, str]]:
    """The contract by a table of all strings, for tests: doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    owner: dict[bytes, int] = {}
    for d, t in docs:
        data = (t or "").encode()
        for i in range(len(data) - size + 1):
            s = data[i:i + size]
            owner[s] = min(owner.get(s, d), d)
    out = {}
    for d, t in docs:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            if owner[data[i:i + size]] < d:
                gone[i:i + size] = b"\1" * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def contaminated(docs: list[tuple], items: list[tuple], n_words: int = 10) -> dict:
    """The contract by plain loops, for tests: doc_id -> (n_words, n_hit, n_items, sha, contaminated)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    keys: dict[tuple, set] = {}
    for item, text in items:
        w = split(text)
        if item is not None and w:
            for i in range(max(1, len(w) - n_words + 1)):
                keys.setdefault(tuple(w[i:i + n_words]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for size in {len(k) for k in keys}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i:i + size])) in keys:
                    hit |= set(range(i, i + size))
                    found |= keys[k]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def nearest(rows: list[tuple[int, np.ndarray]], queries: list[tuple[int, np.ndarray]], k: int = 10) -> dict[int, list[tuple[int, float]]]:
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i, q in queries:
        d = np.sqrt(((x - np.asarray(q, float)) ** 2).sum(1))
        order = np.lexsort((ids, d))
        out[i] = [(int(ids[j]), float(d[j])) for j in order if ids[j] != i][:k]
    return out
