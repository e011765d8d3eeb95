"""Scores of many queries in whole chunks, batch by batch: what leaves a task is the best of its chunks, not a row for each
word, pair of words or chunk that a query meets. numpy in Arrow batches, since no built-in function holds a table of patterns.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a slice of a batch, cells (chunk, query) of its tables, and pairs (occurrence, query) that are added at once.
WORDS, CELLS, STEP = 1 << 19, 1 << 20, 1 << 19
#: Words whose pieces a task keeps.
KNOWN = 1 << 17
#: More than rounding to nine digits can move two scores against each other.
MARGIN = 1e-6


class Lists:
    """Numbers of each key 0 .. n - 1, one behind the other."""

    def __init__(self, lists: list[list[int]]):
        self.size = np.fromiter(map(len, lists), np.int64, len(lists))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.fromiter(chain.from_iterable(lists), np.int64, int(self.size.sum()))

    def expand(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in keys, and number, for each number of each key."""
        n = self.size[keys]
        at = np.repeat(np.arange(len(keys)), n)
        return at, self.flat[np.repeat(self.start[keys] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def steps(self, keys: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of keys with about STEP numbers in all."""
        total = np.cumsum(self.size[keys])
        a = 0
        while a < len(keys):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + STEP, "right")))
            yield a, b
            a = b


class Patterns:
    """What queries look for. queries: (terms, bigrams, quoted phrases), each without repeats; weights of the last two."""

    def __init__(self, queries: list[tuple[list[str], list[str], list[str]]], bigram: float, quoted: float):
        number: dict[str, int] = {}
        asked: dict[int, list[int]] = defaultdict(list)
        wanted: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for q, (terms, bigrams, phrases) in enumerate(queries):
            for t in terms:
                asked[number.setdefault(t, len(number))].append(q)
            for weight, ps in ((bigram, bigrams), (quoted, phrases)):
                for p in ps:
                    wanted[p].append((q, weight))
        self.number, self.asked = number, Lists([asked[i] for i in range(len(number))])
        self.n_terms = np.array([len(q[0]) for q in queries], np.float64)
        self.phrases = list(wanted)
        self.by_phrase = Lists([[q for q, _ in wanted[p]] for p in self.phrases])
        self.weight = np.array([w for p in self.phrases for _, w in wanted[p]])
        # a phrase of one word lies within a token, any other has its first two words in neighbouring ones
        self.inside: dict[str, int] = {}
        self.ends: dict[str, int] = {}
        self.begins: dict[str, int] = {}
        first: dict[tuple[int, int], list[int]] = defaultdict(list)
        self.long = np.zeros(len(self.phrases), bool)
        for i, p in enumerate(self.phrases):
            ws = p.split(" ")
            if len(ws) == 1:
                self.inside[p] = i
            else:
                first[self.ends.setdefault(ws[0], len(self.ends)), self.begins.setdefault(ws[1], len(self.begins))].append(i)
                self.long[i] = len(ws) > 2
        both = sorted(first)
        self.pairs = np.array([a * len(self.begins) + b for a, b in both], np.int64)
        self.by_pair = Lists([first[k] for k in both])
        self.sizes = sorted({len(x) for x in self.inside})
        # pieces by number, and what can still grow to one: -1
        self.tails = {x[k:]: -1 for x in self.ends for k in range(len(x))} | self.ends
        self.heads = {x[:k]: -1 for x in self.begins for k in range(1, len(x))} | self.begins

    def _cut(self, t: str) -> tuple[int, list[int], list[int], list[int]]:
        n, es, bs, ins = len(t), [], [], ()
        for k in range(1, n + 1):
            if (i := self.tails.get(t[n - k:])) is None:
                break
            if i >= 0:
                es.append(i)
        for k in range(1, n + 1):
            if (i := self.heads.get(t[:k])) is None:
                break
            if i >= 0:
                bs.append(i)
        if self.inside:
            ins = list({i for k in self.sizes for j in range(n - k + 1) if (i := self.inside.get(t[j:j + k])) is not None})
        return self.number.get(t, -1), es, bs, ins

    def cut(self, tokens: list[str], known: dict) -> tuple[np.ndarray, Lists, Lists, Lists]:
        """Of each token: its number as a term or -1, the pieces it ends in and begins with, phrases within it. known: tokens
        that the task has cut before, KNOWN at most."""
        if len(known) > KNOWN:
            known.clear()
        for t in tokens:
            if t not in known:
                known[t] = self._cut(t)
        rows = [known[t] for t in tokens]
        return np.array([r[0] for r in rows], np.int64), *(Lists([r[i] for r in rows]) for i in (1, 2, 3))


def _slices(batch: pa.RecordBatch, cells: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[str]]]:
    """Parts of a batch, with the row and the code of each word, and the words by code."""
    column = batch.column("tokens")
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    place, a = np.cumsum(sizes), 0
    while a < len(column):
        b = max(a + 1, min(a + max(1, cells), int(np.searchsorted(place, (place[a - 1] if a else 0) + WORDS, "right"))))
        words = column.slice(a, b - a).flatten().dictionary_encode()
        yield batch.slice(a, b - a), np.repeat(np.arange(b - a), sizes[a:b]), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.to_pylist()
        a = b


def counts(patterns: Patterns):
    """(tokens) to (term, chunks with it, words), a row for each term of a task; term -1: all chunks, and their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(len(patterns.number), np.int64), 0, 0
        for batch in batches:
            for part, row, code, words in _slices(batch, batch.num_rows):
                n, length = n + part.num_rows, length + len(code)
                term = np.array([patterns.number.get(t, -1) for t in words], np.int64)[code]
                met = np.unique(row[term >= 0] * len(df) + term[term >= 0])
                df += np.bincount(met % max(1, len(df)), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([n, *df[some].tolist()], pa.int64()), pa.array([length] + [0] * len(some), pa.int64())], ["term", "n", "words"])

    return run


def _hits(patterns: Patterns, rows: int, row: np.ndarray, code: np.ndarray, cut: tuple, bodies) -> tuple[np.ndarray, np.ndarray]:
    """(row, phrase) of the phrases that a chunk's text holds as characters, each once."""
    _, ends, begins, inside = cut
    n, found = max(1, len(patterns.phrases)), []
    alone = np.flatnonzero(inside.size[code])
    at, p = inside.expand(code[alone])
    found.append(row[alone[at]] * n + p)
    if len(patterns.pairs) and len(code) > 1:
        near = np.flatnonzero((row[1:] == row[:-1]) & (ends.size[code[:-1]] > 0) & (begins.size[code[1:]] > 0))
        two, back = np.unique(code[near] * len(ends.size) + code[near + 1], return_inverse=True)
        x, y = two // len(ends.size), two % len(ends.size)
        at, a = ends.expand(x)
        again, b = begins.expand(y[at])
        key = a[again] * len(patterns.begins) + b
        pair = np.minimum(np.searchsorted(patterns.pairs, key), len(patterns.pairs) - 1)
        some = patterns.pairs[pair] == key
        k, p = patterns.by_pair.expand(pair[some])
        # phrases of each pair of words, in its order
        which = at[again[some][k]]
        held = Lists.__new__(Lists)
        held.size = np.bincount(which, minlength=len(two))
        held.start, held.flat = np.cumsum(held.size) - held.size, p[np.argsort(which, kind="stable")]
        for u, v in held.steps(back):
            at, p = held.expand(back[u:v])
            found.append(np.unique(row[near[u:v][at]] * n + p))
    met = np.unique(np.concatenate(found))
    r, p = met // n, met % n
    if (late := np.flatnonzero(patterns.long[p])).size:
        text, true = bodies(np.unique(r[late])), np.ones(len(p), bool)
        true[late] = [patterns.phrases[j] in text[i] for i, j in zip(r[late].tolist(), p[late].tolist(), strict=True)]
        r, p = r[true], p[true]
    return r, p


def best(patterns: Patterns, weight: np.ndarray, mean: float, limit: int, k1: float, b: float, coverage: float):
    """(chunk_id, ordinal, tokens) to (query, chunk_id, ordinal, raw, matched): every chunk that can be among a query's first
    `limit`, those that tie with the last too. weight: of each term; query: its number."""
    n_queries, n_terms = len(patterns.n_terms), len(patterns.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, known = np.full((limit, n_queries), -np.inf), {}
        for batch in batches:
            for part, row, code, words in _slices(batch, CELLS // n_queries):
                rows = part.num_rows
                cut = patterns.cut(words, known)
                length = np.bincount(row, minlength=rows)
                term = cut[0][code]
                met, tf = np.unique(row[term >= 0] * n_terms + term[term >= 0], return_counts=True)
                r, t = met // max(1, n_terms), met % max(1, n_terms)
                w = weight[t] * (tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length[r] / mean)))
                score, matched, bonus = np.zeros(rows * n_queries), np.zeros(rows * n_queries, np.int64), np.zeros(rows * n_queries)
                for u, v in patterns.asked.steps(t):
                    at, q = patterns.asked.expand(t[u:v])
                    cell = r[u:v][at] * n_queries + q
                    score += np.bincount(cell, w[u:v][at], len(score))
                    matched += np.bincount(cell, minlength=len(score))

                def bodies(some: np.ndarray, part: pa.RecordBatch = part) -> dict[int, str]:
                    return dict(zip(some.tolist(), pc.binary_join(part.column("tokens").take(pa.array(some)), " ").to_pylist(), strict=True))

                r, p = _hits(patterns, rows, row, code, cut, bodies)
                for u, v in patterns.by_phrase.steps(p):
                    at, q = patterns.by_phrase.expand(p[u:v])
                    place = np.repeat(patterns.by_phrase.start[p[u:v]] - (np.cumsum(s := patterns.by_phrase.size[p[u:v]]) - s), s) + np.arange(s.sum())
                    bonus += np.bincount(r[u:v][at] * n_queries + q, patterns.weight[place], len(bonus))
                score = score.reshape(rows, n_queries) * (1.0 + coverage * matched.reshape(rows, n_queries) / patterns.n_terms) + bonus.reshape(rows, n_queries)
                if rows > limit:
                    top = np.concatenate([top, np.partition(score, rows - limit, axis=0)[rows - limit:]])
                else:
                    top = np.concatenate([top, score])
                top = np.partition(top, len(top) - limit, axis=0)[len(top) - limit:]
                at, q = np.nonzero((score > 0) & (score >= top.min(axis=0) - MARGIN))
                if len(at):
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), part.column("chunk_id").take(take), part.column("ordinal").take(take), pa.array(score[at, q]), pa.array(matched.reshape(rows, n_queries)[at, q], pa.int64())], ["query", "chunk_id", "ordinal", "raw", "matched"])

    return run
