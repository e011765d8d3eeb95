"""Token counts by compiled finite-state transducers.

Byte-level BPE counts of whole texts, as the tokenizers library gives them for a byte-level vocabulary with its
standard split pattern. Two deterministic transducers:

* `SPLIT` reads code-point classes and annotates its transitions with piece boundaries (before this, or before the
  previous character). A text is cut into chunks; each chunk's map from every start state to its end state is
  computed in lock step, the maps compose by parallel prefix scan, and a second sweep from the now known start
  states emits the boundaries.
* `Merges` reads the bytes of a piece from its boundary on and annotates its transitions with the tokens gained. It has
  far more states than could be tabled for every start, so states and transitions are compiled at their first use and
  kept in tables of bounded size; a chunk's map is taken from the one start state that is reached, and maps compose by
  adding their counts. A boundary is the state in which nothing before matters, so that pieces are counted apart, each
  kind of piece once, and a prefix sum over the pieces gives the counts of all texts.

Time and memory grow with the text's length only, also within one piece (a line of letters without any blank), about
3 microseconds a byte where no transition is met twice.

Special strings in a text count as one token each, the library's default. Defined results: null and empty texts have
no bytes and no tokens; each row gets its own result, also if doc_id is null or repeated; an empty table gives an
empty result; further columns stay, those named like results are replaced.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import small_batches, table, without

# Classes of code points.
END, BLANK, SPACE, NUMBER, OTHER, QUOTE, LETTER, STMD, RV, E, ELL = range(11)
# States: a new piece begins; in letters, numbers, others; whitespace that ends in a blank or in another; after an
# apostrophe that begins a piece; after that and r or v; after that and l.
START, IN_L, IN_N, IN_O, IN_B, IN_S, IN_Q, IN_RV, IN_ELL = range(9)
# Annotations: a piece begins at this character; at the one before.
HERE, BEFORE = 1, 2


def _split_table() -> tuple[np.ndarray, np.ndarray]:
    step, mark = np.zeros((11, 9), np.uint8), np.zeros((11, 9), np.uint8)
    kind = {NUMBER: IN_N, OTHER: IN_O, LETTER: IN_L, STMD: IN_L, RV: IN_L, E: IN_L, ELL: IN_L}
    for s in range(9):
        step[END, s], mark[END, s] = START, HERE | (BEFORE if s in (IN_RV, IN_ELL) else 0)
        late = BEFORE if s in (IN_RV, IN_ELL) else 0  # it was no contraction
        run = IN_L if late else s
        for c in (BLANK, SPACE):
            step[c, s], mark[c, s] = (IN_B if c == BLANK else IN_S), late | (0 if run in (IN_B, IN_S) else HERE)
        for c, to in kind.items():
            if run == IN_B:
                step[c, s], mark[c, s] = to, BEFORE
            elif run == IN_S:
                step[c, s], mark[c, s] = to, BEFORE | HERE
            else:
                step[c, s], mark[c, s] = to, late | (0 if run == to or run == IN_Q and to == IN_O else HERE)
        if run == IN_B:
            step[QUOTE, s], mark[QUOTE, s] = IN_O, BEFORE
        elif run == IN_S:
            step[QUOTE, s], mark[QUOTE, s] = IN_Q, BEFORE | HERE
        elif run in (IN_O, IN_Q):
            step[QUOTE, s], mark[QUOTE, s] = IN_O, 0
        else:
            step[QUOTE, s], mark[QUOTE, s] = IN_Q, late | HERE
    for c, s, to in ((STMD, IN_Q, START), (RV, IN_Q, IN_RV), (ELL, IN_Q, IN_ELL), (E, IN_RV, START), (ELL, IN_ELL, START)):
        step[c, s], mark[c, s] = to, 0
    return step.ravel(), mark.ravel()


STEP, MARK = _split_table()


def read_classes(pre_tokenizer) -> np.ndarray:
    """Class of every code point. Where two Unicode versions at hand disagree, the library's own split decides."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every, place = "".join(map(chr, points)), np.array(points)
    out = np.full(0x110000, OTHER, np.uint8)
    for letter, base, c in (("L", "a", LETTER), ("N", "1", NUMBER)):
        newer = np.zeros(0x110000, bool)
        for m in regex.finditer(rf"\p{{{letter}}}+", every):
            newer[place[m.start():m.end()]] = True
        older = np.array([unicodedata.category(ch)[0] == letter for ch in every])
        yes = newer.copy()
        yes[place] &= older
        for cp in place[newer[place] != older].tolist():
            yes[cp] = len(pre_tokenizer.pre_tokenize_str(base + chr(cp))) == 1
        out[yes] = c
    for cp in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[cp] = SPACE
    for ch, c in ((" ", BLANK), ("'", QUOTE), ("e", E), ("l", ELL), *((x, STMD) for x in "stmd"), *((x, RV) for x in "rv")):
        out[ord(ch)] = c
    return out


def boundaries(classes: np.ndarray, chunk: int = 192) -> np.ndarray:
    """Where pieces begin; classes: uint8 of any length, ending in END."""
    n = len(classes)
    k = -(-n // chunk)
    cols = np.zeros((k, chunk), np.int16)
    cols.ravel()[:n] = classes
    cols = np.ascontiguousarray(cols.T) * 9
    maps = np.tile(np.arange(9, dtype=np.int16), (k, 1))
    for c in range(chunk):
        maps = STEP.take(cols[c][:, None] + maps)
    # inclusive scan: after round r, maps[i] composes the chunks i - 2**(r+1) + 1 .. i
    maps, far = maps.astype(np.int16), 1
    while far < k:
        joined = np.take_along_axis(maps[far:], maps[:-far], axis=1)
        maps = np.concatenate([maps[:far], joined])
        far *= 2
    state = np.zeros(k, np.int16)
    state[1:] = maps[:-1, START]
    marks = np.empty((chunk, k), np.uint8)
    for c in range(chunk):
        at = cols[c] + state
        marks[c] = MARK.take(at)
        state = STEP.take(at).astype(np.int16)
    marks = np.ascontiguousarray(marks.T).ravel()[:n]
    starts = (marks & HERE) != 0
    starts[:-1] |= (marks[1:] & BEFORE) != 0
    return np.flatnonzero(starts)


class Merges:
    """Token counts of pieces, by a transducer over bytes that is compiled as its states are met.

    vocabulary: token bytes -> id; ranks: (left id, right id) -> (rank, merged id). A state holds what of a beginning
    still matters: the last bytes that may begin a token, and at each place in them the last token before it with the
    tokens up to there. A byte's transition is annotated with the tokens that the beginning gains by it.
    """

    def __init__(self, vocabulary: dict[bytes, int], ranks: dict[tuple[int, int], tuple[int, int]], room: int = 1_000_000):
        self.vocabulary, self.ranks, self.room = vocabulary, ranks, room
        self.bytes_of = {i: b for b, i in vocabulary.items()}
        self.openings = {b[:i] for b in vocabulary for i in range(1, len(b))}
        self.made = {m: (rank, a, b) for (a, b), (rank, m) in ranks.items()}
        self.edges: tuple[dict, dict] = ({}, {})
        self.apart: dict[tuple[int, int], bool] = {}
        self.counts: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        #: transitions: state << 8 | byte -> next state << 10 | gained tokens + 512
        self.steps: dict[int, int] = {}
        self.states: list[tuple[bytes, tuple]] = [(b"", ((0, -1, 0),))]
        self.numbers: dict[tuple[bytes, tuple], int] = {self.states[0]: 0}

    def merge(self, data: bytes) -> list[int]:
        ids = [self.vocabulary[bytes((b,))] for b in data]
        while len(ids) > 1:
            rank, at = min((self.ranks.get(p, (1 << 60, 0))[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == 1 << 60:
                break
            ids[at:at + 2] = [self.ranks[ids[at], ids[at + 1]][1]]
        return ids

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """What stands at a token's right or left edge while it is merged, each with the rank that ends it."""
        known = self.edges[right]
        if (out := known.get(token)) is None:
            out, part, until = [], token, float("inf")
            while True:
                out.append((part, until))
                if part not in self.made:
                    break
                until, *halves = self.made[part]
                part = halves[right]
            known[token] = out
        return out

    def compatible(self, before: int, token: int) -> bool:
        """Whether two tokens stay apart: no merge across them comes before those that build them, leftmost first
        at equal rank. before: -1 at the start of a piece, where the token has to build itself."""
        key = (before, token)
        if (known := self.apart.get(key)) is None:
            if before < 0:
                known = self.merge(self.bytes_of[token]) == [token]
            else:
                known = all(
                    (r := self.ranks.get((x, y))) is None or r[0] >= ends_x or r[0] > ends_y
                    for x, ends_x in self.edge(before, True) for y, ends_y in self.edge(token, False)
                )
            if len(self.apart) >= self.room // 2:
                self.apart.clear()
            self.apart[key] = known
        return known

    def compiled(self, state: int, byte: int) -> int:
        """The transition of a state by a byte, made at its first use."""
        tail, live = self.states[state]
        tail += bytes((byte,))
        found, more, openings, vocabulary, apart = None, [], self.openings, self.vocabulary, self.apart
        for at, last, so_far in live:
            part = tail[at:]
            if found is None and (token := vocabulary.get(part)) is not None:
                fits = apart.get((last, token))
                if self.compatible(last, token) if fits is None else fits:
                    found = (token, so_far + 1)
            if part in openings:
                more.append((at, last, so_far))
        if found is None:
            raise ValueError("the vocabulary lacks a byte")
        token, gain = found
        base = more[0][0] if more else len(tail)
        to = (tail[base:], (*[(at - base, last, so_far - gain) for at, last, so_far in more], (len(tail) - base, token, 0)))
        full = len(self.steps) >= self.room // 2
        if full:
            self._forget()
        if (number := self.numbers.get(to)) is None:
            number = self.numbers[to] = len(self.states)
            self.states.append(to)
        step = number << 10 | gain + 512
        if not full:
            self.steps[state << 8 | byte] = step
        return step

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        """The map of a chunk from a state: the state after it and the tokens gained. Maps compose by adding the counts."""
        total, steps = 0, self.steps
        for byte in data:
            step = steps.get(state << 8 | byte)
            if step is None:
                step = self.compiled(state, byte)
                steps = self.steps
            state = step >> 10
            total += (step & 1023) - 512
        return state, total

    def count(self, piece: str) -> int:
        if (n := self.counts.get(piece)) is None:
            n = self.run(0, piece.encode("utf-8", "surrogatepass"))[1]
            if len(piece) <= 64:
                if len(self.counts) >= self.room:
                    self.counts.clear()
                self.counts[piece] = n
        return n


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary file: printable Latin-1 stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """What the transducers need of a byte-level BPE file, read on the driver (some MB at most)."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or spec["normalizer"]:
        raise ValueError("byte-level BPE without normaliser and prefix space is asked for")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    classes = read_classes(Tokenizer.from_file(path).pre_tokenizer)
    return {"vocab": spec["model"]["vocab"], "merges": merges, "special": [t["content"] for t in spec["added_tokens"]], "classes": classes}


class Counter:
    """Both transducers for one vocabulary."""

    def __init__(self, spec: dict):
        letter = _byte_letters()
        raw = {t: bytes(letter[ch] for ch in t) for t in spec["vocab"] if all(ch in letter for ch in t)}
        ids = spec["vocab"]
        ranks = {(ids[a], ids[b]): (i, ids[a + b]) for i, (a, b) in reversed(list(enumerate(spec["merges"])))}
        self.merges = Merges({b: ids[t] for t, b in raw.items()}, ranks)
        self.special, self.classes = spec["special"], spec["classes"]

    def segments(self, text: str) -> tuple[list[str], int]:
        """Text between special strings, and how many of these there are."""
        parts = [text]
        for s in self.special:
            parts = [x for p in parts for x in p.split(s)]
        return parts, len(parts) - 1

    def count(self, texts: list[str], limit: int = 1 << 21) -> list[int]:
        """Tokens of each text; several are read at once, up to `limit` characters."""
        out, held, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            parts, out[i] = self.segments(text)
            for p in parts:
                if p:
                    held.append((i, p))
                    size += len(p)
            if size >= limit or i == len(texts) - 1:
                if held:
                    self._read(held, out)
                held, size = [], 0
        return out

    def _read(self, held: list[tuple[int, str]], out: list[int]) -> None:
        whole = "\n".join(p for _, p in held) + "\n"
        classes = self.classes.take(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32))
        ends = np.cumsum([len(p) + 1 for _, p in held]) - 1
        classes[ends] = END
        starts = boundaries(classes)
        at = np.searchsorted(starts, ends)  # END begins a piece of its own
        places = starts.tolist()
        known, count = self.merges.counts.get, self.merges.count
        gained = [known(whole[a:b]) for a, b in zip(places, places[1:], strict=False)]
        if None in gained:
            gained = [count(whole[a:b]) if n is None else n for n, a, b in zip(gained, places, places[1:], strict=False)]
        gained.append(0)  # the last END
        # boundaries annotated with the tokens of their pieces: by a prefix sum each text's are a difference
        gained = np.array(gained, np.int64)
        gained[at] = 0
        sums = np.cumsum(gained)[at]
        for (i, _), n in zip(held, np.diff(sums, prepend=0).tolist(), strict=True):
            out[i] += n


_counters: dict = {}


def _counting(shared, text: str):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(shared.value)
        counter = _counters[key]
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != text]
            names = [x for x in batch.schema.names if x != text]
            yield pa.RecordBatch.from_arrays([*rest, size, pa.array(counter.count(texts), pa.int64())], [*names, "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, *, text: str = "text") -> DataFrame:
    """docs without text, and n_bytes and n_tokens (long). vocabulary: path of a byte-level BPE .json on the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, "n_bytes", "n_tokens")
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    kept = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(_counting(shared, text), T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


QUERIES = {"op6_token_counts": op6}
SQL: dict[str, str] = {}
