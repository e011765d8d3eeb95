"""Personal data: exact base patterns, and a linear-chain conditional random field that adds spans to them.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and without overlaps per kind; matches that fail
a kind's test are dropped. The field labels tokens with B-/I- tags of the kinds and `secret` (keys, passwords,
tokens) over word-shape features; it is fitted by gradient ascent on a small labelled table. A chain is a line; all
tokens of all lines are decoded by Viterbi, in numpy steps over all lines of a batch at once. What a word adds to the
score is kept for words met before. Spans it finds are added where they overlap no base span and, for cards, addresses
and phones, pass the kind's test on their digits.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; each row gets its own
result, also if doc_id is null or repeated; of tags with equal scores the first in the order of TAGS is taken; texts
and words of any length are read whole (memory grows with the longest line, about 60 bytes a token); further columns
stay, a column named pii is replaced; an empty table gives an empty result; an empty labelled table gives no added spans.
"""

from __future__ import annotations

import random
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import small_batches, table, without

#: Kinds in the order of the output; the first four have base patterns (fixed values).
KINDS = ("email", "ip", "card", "phone", "secret")
Span = tuple[int, int, int]  # start, kind number, end

# The patterns of the contract, written so that no start inside a run is tried twice (linear in the text).
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = ord(ch) - 48
        n = n * 2 if i % 2 else n
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            floor = m.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)
    if _HAS_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


_HAS_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_LEAD, _TRAIL = "([{<\"'", ".,;:!?)]}>\"'"
_EDGES = _LEAD + _TRAIL
_HEAD = re.compile(r"[^\W\d_]*(?:_[^\W\d_]+)*")

BITS = 14
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Features of a word itself, and of it with its neighbours.
OWN, BESIDE = 8, 5
N_FEATURES = OWN + BESIDE


class _Classes(dict):
    """Letters by case and digits; other characters stand for themselves."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = out = "X" if c.isupper() else "x" if c.islower() else "d" if c.isdigit() else c
        return out


_CLASSES = _Classes()


def shape(word: str) -> str:
    return word.translate(_CLASSES)


def squeezed(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1", s)


def _crc(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass"))


def keys(word: str) -> tuple[str, str]:
    """What a word's features depend on: its shape with a closing : or =, and its first letters."""
    w = word.strip(_EDGES)
    end = word[-1] if word[-1] in ":=" else ""
    head = w.lower() if w.isalpha() else _HEAD.match(w)[0].lower()
    return w.translate(_CLASSES) + "\0" + end, head + ("=" if "=" in w else end) if len(head) <= 16 else ""


def shape_features(key: str) -> list[int]:
    """Features of a shape, then a hash of it for its neighbours."""
    s, end = key.split("\0")
    tight, digits, size = squeezed(s), s.count("d"), min(len(s), 40) // 2
    named = (
        f"t{tight}", f"s{s[:10]}", f"e{s[-8:]}|{digits > 0}|{end}", f"n{size}|{squeezed(tight.replace('X', 'x'))[:4]}", f"d{min(digits, 20)}|{size}",
        f"m{'@' in s}{'=' in s}{'+' in s}{min(s.count('.'), 4)}{'-' in s}{':' in s}", f"u{s.count('X') > 3}{digits > 0}{s.count('x') > 0}{len(s) > 11}",
    )
    return [*(_crc(f) & ((1 << BITS) - 1) for f in named), _crc(f"{tight}|{end}|{len(s) > 7}|{digits > 0}")]


def head_features(head: str) -> list[int]:
    return [_crc("w" + head) & ((1 << BITS) - 1), _crc("h" + head)]


def _beside(x: np.ndarray, y: np.ndarray, salt: int) -> np.ndarray:
    """Feature of two hashes (uint32)."""
    z = (x * np.uint32(0x9E3779B1)) ^ (y * np.uint32(0x85EBCA77) + np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF))
    z ^= z >> np.uint32(15)
    z *= np.uint32(0xC2B2AE3D)
    return (z >> np.uint32(32 - BITS)).astype(np.int32)


_NONE = np.uint32(0)


def beside_features(tight: np.ndarray, head: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """BESIDE features of each token of chains laid end to end; first, last: whether a token begins or ends its chain."""
    before, after, named = np.roll(tight, 1), np.roll(tight, -1), np.roll(head, 1)
    before[first] = named[first] = after[last] = _NONE
    none = np.zeros_like(tight)
    return [_beside(before, none, 1), _beside(after, none, 2), _beside(before, tight, 3), _beside(tight, after, 4), _beside(named, none, 5)]


class Table:
    """Scores and hashes of keys met, by number."""

    def __init__(self, make, weights: np.ndarray):
        self.make, self.weights = make, weights
        self.places: dict[str, int] = {}
        self.own, self.hashes = np.zeros((64, weights.shape[1]), np.float32), np.zeros(64, np.uint32)

    def place(self, key: str) -> int:
        if (at := self.places.get(key)) is None:
            at = self.places[key] = len(self.places)
            if at == len(self.own):
                self.own, self.hashes = np.concatenate([self.own, np.zeros_like(self.own)]), np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            *own, name = self.make(key)
            self.own[at], self.hashes[at] = self.weights[own].sum(0), name
        return at


class Field:
    """Weights of features by tag and of tag pairs; training, and decoding of chains laid end to end.

    heads: beginnings of words that training met often enough; all others count as one.
    """

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None, heads: frozenset[str] = frozenset(), fitted: bool = False, room: int = 150_000):
        n = len(TAGS)
        self.weights = np.zeros((1 << BITS, n), np.float32) if weights is None else weights
        self.moves = np.zeros((n + 1, n), np.float32) if moves is None else moves  # last row: start
        self.heads, self.fitted, self.room = heads, fitted, room
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}  # shape << 32 | head
        self.shapes, self.firsts = Table(shape_features, self.weights), Table(head_features, self.weights)

    def fit(self, sentences: list[tuple[list[str], list[int]]], *, rounds: int = 50, rate: float = 0.3, ridge: float = 1e-3, least: int = 8) -> None:
        """Full-batch AdaGrad on the conditional log likelihood, by forward and backward sums."""
        sentences = sorted((s for s in sentences if s[0]), key=lambda s: -len(s[0]))
        if not sentences:
            return
        n, b, t = len(TAGS), len(sentences), max(len(w) for w, _ in sentences)
        sizes = np.array([len(w) for w, _ in sentences])
        feats, tags, real = np.zeros((b, t, N_FEATURES), np.int32), np.zeros((b, t), int), np.arange(t)[None] < sizes[:, None]
        often = Counter(keys(w)[1] for words, _ in sentences for w in words)
        self.heads = frozenset(h for h, k in often.items() if k >= least)
        feats[real] = self.features([w for words, _ in sentences for w in words], sizes)
        tags[real] = [y for _, ys in sentences for y in ys]
        real = real.astype(float)
        used, local = np.unique(feats, return_inverse=True)
        local = local.reshape(feats.shape)
        w, moves = np.zeros((len(used), n)), np.zeros((n + 1, n))
        gw, gm = np.full_like(w, 1e-6), np.full_like(moves, 1e-6)
        for _ in range(rounds):
            _, dw, dm = gradient(w, moves, local, tags, real)
            dw, dm = dw - ridge * b * w, dm - ridge * b * moves
            gw, gm = gw + dw * dw, gm + dm * dm
            w += rate * dw / np.sqrt(gw)
            moves += rate * dm / np.sqrt(gm)
        self.weights[used], self.moves, self.fitted = w, moves.astype(np.float32), True
        self._forget()

    def _split(self, word: str) -> tuple[str, str]:
        form, head = keys(word)
        return form, head if head in self.heads else ""

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of each word's shape and head. Long words aren't kept by name."""
        if len(self.words) > self.room or len(self.shapes.places) > self.room:
            self._forget()
        get = self.words.get
        out = list(map(get, words))
        for i, at in enumerate(out):
            if at is None and (at := get(words[i])) is None:
                form, head = self._split(words[i])
                at = self.shapes.place(form) << 32 | self.firsts.place(head)
                if len(words[i]) <= 64:
                    self.words[words[i]] = at
            out[i] = at
        both = np.array(out, np.int64)
        return both >> 32, both & 0xFFFFFFFF

    def scores(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """Of each token of chains laid end to end, for each tag."""
        form, head = self._known(words)
        out = self.shapes.own[form] + self.firsts.own[head]
        for f in beside_features(self.shapes.hashes[form], self.firsts.hashes[head], *_borders(sizes)):
            out += self.weights[f]
        return out

    def features(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """N_FEATURES of each token of chains laid end to end."""
        split = [self._split(w) for w in words]
        form, head = np.array([shape_features(f) for f, _ in split], np.int64), np.array([head_features(h) for _, h in split], np.int64)
        beside = beside_features(form[:, -1].astype(np.uint32), head[:, -1].astype(np.uint32), *_borders(sizes))
        return np.column_stack([form[:, :-1], head[:, :-1], *beside]).astype(np.int32)

    def decode(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """Best tags of chains laid end to end (none of them empty), by Viterbi; one step for all chains at a time."""
        n = len(TAGS)
        out = np.zeros(len(words), np.int8)
        if not len(sizes):
            return out
        s = self.scores(words, sizes)
        order = np.argsort(-sizes, kind="stable")
        start = (np.cumsum(sizes) - sizes)[order]
        left = -sizes[order]
        back = np.zeros((len(words), n), np.int8)
        best = s[start] + self.moves[n]
        moves, across = self.moves[:n], np.ascontiguousarray(self.moves[:n].T)
        ends = np.zeros(len(sizes), np.int8)
        steps = int(sizes.max())
        for k in range(1, steps):
            m = int(np.searchsorted(left, -k, "left"))  # chains of more than k tokens
            if m < len(best):
                ends[m:len(best)] = best[m:].argmax(1)
                best = best[:m]
            if m < 48:
                x = best[:, None, :] + across
                arg = x.argmax(2)
                top = np.take_along_axis(x, arg[:, :, None], 2)[:, :, 0]
            else:
                top, arg = best[:, :1] + moves[0], np.zeros((m, n), np.int8)
                for f in range(1, n):
                    x = best[:, f:f + 1] + moves[f]
                    arg[x > top] = f
                    np.maximum(top, x, out=top)
            at = start[:m] + k
            back[at] = arg
            best = top + s[at]
        ends[:len(best)] = best.argmax(1)
        tag = ends.copy()
        for k in range(steps - 1, -1, -1):
            m = int(np.searchsorted(left, -k, "left"))
            at = start[:m] + k
            out[at] = tag[:m]
            tag[:m] = back[at, tag[:m]]
        return out


def _borders(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    return ends - sizes, ends - 1


def gradient(w: np.ndarray, moves: np.ndarray, local: np.ndarray, tags: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of padded sentences, longest first, and its gradient. local: sentences x tokens x features, rows of w; real: 1 or 0."""
    (b, t, per), n = local.shape, w.shape[1]
    here, s = real > 0, np.zeros((b, t, n))
    s[here] = w[local[here]].sum(1)
    alpha, beta = np.zeros((b, t, n)), np.zeros((b, t, n))
    longer = here.sum(0)  # how many sentences have a token at each place
    alpha[:, 0] = s[:, 0] + moves[n]
    for k in range(1, t):
        m = longer[k]
        x = alpha[:m, k - 1, :, None] + moves[None, :n]
        top = x.max(1)
        alpha[:m, k] = s[:m, k] + top + np.log(np.exp(x - top[:, None]).sum(1))
        alpha[m:, k] = alpha[m:, k - 1]
    for k in range(t - 2, -1, -1):
        m = longer[k + 1]
        x = moves[None, :n] + (s[:m, k + 1] + beta[:m, k + 1])[:, None, :]
        top = x.max(2)
        beta[:m, k] = top + np.log(np.exp(x - top[..., None]).sum(2))
    top = alpha[:, -1].max(1)
    z = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(1))
    p = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
    gold = np.eye(n)[tags] * real[..., None]
    pairs = real[:, 1:] > 0
    dm = np.zeros_like(moves)
    np.add.at(dm, (np.full(b, n), tags[:, 0]), 1)
    np.add.at(dm, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
    reached = (moves * dm).sum() + (s * gold).sum()
    dm[n] -= p[:, 0].sum(0)
    for k in range(1, t):
        m = longer[k]
        dm[:n] -= np.exp(alpha[:m, k - 1, :, None] + moves[None, :n] + (s[:m, k] + beta[:m, k])[:, None, :] - z[:m, None, None]).sum(0)
    each, flat = (gold - p)[here], local[here].ravel()
    dw = np.stack([np.bincount(flat, np.repeat(each[:, j], per), len(w)) for j in range(n)], 1)
    return float(reached - z.sum()), dw, dm


def tagged_spans(tokens: list[tuple[str, int, int]], tags: list[int]) -> list[Span]:
    out: list[Span] = []
    open_kind = -1
    for (word, start, end), tag in zip(tokens, tags, strict=True):
        kind = (tag - 1) // 2 if tag else -1
        a = start + len(word) - len(word.lstrip(_LEAD))
        b = end - (len(word) - len(word.rstrip(_TRAIL)))
        if kind >= 0 and a < b:
            if kind == open_kind and (tag - 1) % 2:
                out[-1] = (out[-1][0], kind, b)
            else:
                out.append((a, kind, b))
        open_kind = kind
    return out


def plausible(kind: int, found: str) -> bool:
    """Shapes can't tell a card or an address from other numbers; their tests can."""
    d = _NOT_DIGIT.sub("", found)
    if KINDS[kind] == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if KINDS[kind] == "ip":
        return bool(m := _IP.fullmatch(found)) and all(int(p) <= 255 for p in m[0].split(".") if len(p) < 9) and max(map(len, m[0].split("."))) < 9
    return "@" in found if KINDS[kind] == "email" else KINDS[kind] != "phone" or 7 <= len(d) <= 15


def find_spans(texts: list[str], field: Field, room: int = 400_000) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text; about `room` tokens are decoded at a time."""
    base = [base_spans(t) for t in texts]
    if not field.fitted:
        return [(b, []) for b in base]
    added: list[list[Span]] = [[] for _ in texts]
    words, sizes, lines = [], [], []

    def read() -> None:
        tags, at = field.decode(words, np.array(sizes, np.int64)), 0
        ends = np.cumsum(np.array(sizes, np.int64))
        for j in np.unique(np.searchsorted(ends, np.flatnonzero(tags), "right")).tolist():
            i, start, end = lines[j]
            line = texts[i][start:end]
            tokens = [(m[0], start + m.start(), start + m.end()) for m in _TOKEN.finditer(line)]
            at = int(ends[j])
            added[i] += [s for s in tagged_spans(tokens, tags[at - sizes[j]:at].tolist()) if plausible(s[1], texts[i][s[0]:s[2]])]
        words.clear(), sizes.clear(), lines.clear()

    for i, t in enumerate(texts):
        start = 0
        for line in t.split("\n"):
            if found := line.split():
                words += found
                sizes.append(len(found))
                lines.append((i, start, start + len(line)))
                if len(words) >= room:
                    read()
            start += len(line) + 1
    read()
    out = []
    for b, more in zip(base, added, strict=True):
        apart, k = [], 0
        ends = sorted(b)
        for s in sorted(more):
            while k < len(ends) and ends[k][2] <= s[0] and k + 1 < len(ends) and ends[k + 1][2] <= s[0]:
                k += 1
            if all(x[2] <= s[0] or x[0] >= s[2] for x in ends[max(0, k - 4):k + 8]):
                apart.append(s)
        out.append((b, apart))
    return out


def labelled_rows(n: int = 1000, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The small labelled table: sentences of made-up words with personal data and look-alikes, by templates."""
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    letters = lambda k, of="abcdefghijklmnopqrstuvwxyz": "".join(rnd.choice(of) for _ in range(k))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    hexa = "0123456789abcdef"
    name = lambda: letters(rnd.randint(3, 9))
    named = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "key", "access_key", "auth_token", "client_secret", "Password", "API_KEY")
    value = lambda: letters(rnd.randint(8, 40), rnd.choice((hexa, "abcdefghijklmnopqrstuvwxyz", upper.lower(), upper + upper.lower())))
    quoted = lambda v: rnd.choice((v, v, f'"{v}"', f"'{v}'"))
    def word() -> str:
        w = letters(rnd.randint(1, 11), "aeiouthnrsdlcéèäüßñó")
        w = rnd.choice((w, w, w, w.capitalize(), w.upper())) if rnd.random() < 0.4 else w
        return w + (rnd.choice(".,;!?") if rnd.random() < 0.15 else "")

    makers = {
        "email": [lambda: f"{name()}.{digits(2)}@{name()}{digits(1)}.example.com", lambda: f"{name()}@{name()}.org", lambda: f"{name()}_{name()}+{name()}@{name()}.co.uk"],
        "ip": [lambda: ".".join(str(rnd.randint(1, 255)) for _ in range(4))],
        "card": [lambda: "4" + digits(15), lambda: " ".join(digits(4) for _ in range(4)), lambda: "-".join(digits(4) for _ in range(4))],
        "phone": [lambda: f"+{rnd.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+{rnd.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}"],
        "secret": [
            lambda: "AKIA" + letters(16, upper), lambda: f'token = "{letters(40, hexa)}"', lambda: f"sk-{letters(32, upper + upper.lower())}", lambda: f"ghp_{letters(36, upper + upper.lower())}",
            *(lambda: f"{rnd.choice(named)}{rnd.choice(('=', '=', ': ', ' = ', ':'))}{quoted(value())}" for _ in range(5)),
        ],
    }
    plain = [
        lambda: f"{rnd.randint(1900, 2030)}", lambda: f"{rnd.randint(1, 31)}.{rnd.randint(1, 12)}.{rnd.randint(1990, 2030)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"${digits(2)}.{digits(2)}",
        lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(2)}%", lambda: f"x={digits(1)}", lambda: f"{name()}={name()}", lambda: f"@{name()}", lambda: digits(rnd.randint(1, 7)),
        lambda: f"{name()}{digits(1)}", lambda: f"{digits(1)},{digits(3)}", lambda: f"count = {digits(2)}", lambda: f"https://{name()}.example.org/{name()}?page={digits(1)}", lambda: f"{digits(3)}-{digits(3)}", lambda: "4.0.", lambda: f"{name()}:{digits(2)}",
        lambda: f"{name()}: {name()}", lambda: f"{name()} = {name()}", lambda: f"the {rnd.choice(named)} {name()}", lambda: f"{rnd.choice(named)} is {name()}", lambda: f"{name()}: {letters(rnd.randint(8, 14))}", lambda: f'{name()} = "{name()}"',
        *(lambda: " ".join(f"{word()}{rnd.choice(('***', '###', '%%%', '&&&', '$$$', '|', '...', ',***', '.***'))}" for _ in range(rnd.randint(1, 3))) for _ in range(3)),
        lambda: "| " + " | ".join(digits(rnd.randint(1, 4)) for _ in range(3)) + " |", lambda: "-" * rnd.randint(2, 40),
    ]

    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rnd.randint(1, 4)):
            text += "".join(word() + rnd.choice((" ", " ", " ", "\n")) for _ in range(rnd.randint(0, 5)))
            if rnd.random() < 0.6:
                kind = rnd.choice(("email", "ip", "card", "phone", "secret", "secret", "secret"))
                made = rnd.choice(makers[kind])()
                spans.append((len(text), len(text) + len(made), kind))
                text += made + rnd.choice(("", "", ".", ",")) + " "
            else:
                text += rnd.choice(plain)() + " "
        rows.append((text, spans))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    kind = "text string, spans array<struct<start:int,end:int,kind:string>>"
    return spark.createDataFrame(labelled_rows(), kind)


def sentences(text: str, spans: list) -> list[tuple[list[str], list[int]]]:
    """Words and tags of each line; spans: (start, end, kind)."""
    out, start = [], 0
    for line in text.split("\n"):
        words, tags = [], []
        for m in _TOKEN.finditer(line):
            tag = 0
            for a, b, kind in spans:
                if start + m.start() < b and start + m.end() > a and kind in KINDS:
                    tag = 1 + 2 * KINDS.index(kind) + (start + m.start() > a)
            words.append(m[0])
            tags.append(tag)
        if words:
            out.append((words, tags))
        start += len(line) + 1
    return out


def train(labelled: DataFrame, *, max_rows: int = 5000) -> Field:
    """Fitted on at most max_rows texts of the labelled table, those with the smallest hash."""
    rows = labelled.filter("text is not null").orderBy(F.xxhash64("text"), "text").limit(max_rows).collect()
    field = Field()
    field.fit([s for r in rows for s in sentences(r.text, r.spans or [])])
    return field


FOUND = "array<struct<start:bigint,end:bigint,kind:string,base:boolean>>"


_fields: dict[str, Field] = {}


def _finder(shared, text: str):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _fields:
            _fields.clear()
            _fields[key] = Field(*shared.value)
        field = _fields[key]
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            rows = []
            for base, added in find_spans(texts, field):
                every = sorted([(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in added])
                rows.append([{"start": s, "end": e, "kind": KINDS[k], "base": b} for s, k, e, b in every])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, "pii"])

    return run


def personal_data(docs: DataFrame, field: Field, *, text: str = "text") -> DataFrame:
    """docs and pii: array of (start, end, kind, base), by start and kind; base tells the fixed patterns' spans."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, "pii")
    shared = spark.sparkContext.broadcast((field.weights, field.moves, field.heads, field.fitted))
    schema = T.StructType([*docs.schema.fields, T.StructField("pii", T._parse_datatype_string(FOUND))])
    return docs.mapInArrow(_finder(shared, text), schema)


def masked(found: DataFrame, *, text: str = "text") -> DataFrame:
    """found (of personal_data) with each span of text replaced by <KIND>; overlapping spans become one mark."""
    first = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))
    cut = lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), (b - a).cast("int"))

    def step(s, x):
        mark = F.concat(s.done, cut(s["at"], x.start), F.lit("<"), F.upper(x.kind), F.lit(">"))
        return F.struct(F.when(x.start >= s["at"], mark).otherwise(s.done).alias("done"), F.greatest(s["at"], x.end).alias("at"))

    rest = lambda s: F.concat(s.done, cut(s["at"], F.length(text).cast("bigint")))
    return found.withColumn(text, F.when(F.size("pii") > 0, F.aggregate("pii", first, step, rest)).otherwise(F.col(text)))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), train(labelled_table(spark)))
    base = F.filter("pii", lambda s: s.base)
    of = lambda kind: lambda s: s.kind == kind
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


QUERIES = {"op3_personal_data": op3}
SQL: dict[str, str] = {}
