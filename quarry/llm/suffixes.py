"""Column-wise construction of the Burrows-Wheeler transform of a collection of short texts, with common prefixes.

Round j inserts the suffix of length j of every text that is that long, one symbol per text. The state is two
sequential files that each round reads once and writes anew: the transform (symbol before each suffix) and the length
of the common prefix with the suffix before it in the order. The place of a new suffix follows from the transform
alone: symbols smaller than its own, plus equal ones before the place of the suffix it extends; its common prefixes
are one more than the smallest between the neighbouring equal symbols. Files below `SPILL` bytes stay in memory.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

CAP = 255
SPILL = 64 << 20


class Files:
    """transform (symbols, 0: the text's beginning) and prefix (uint8), in memory while small, then on disk."""

    def __init__(self, kind: type):
        self.kinds, self.held, self.folder = (kind, np.uint8), None, None

    def read(self) -> list[np.ndarray]:
        return self.held or [np.fromfile(os.path.join(self.folder.name, str(i)), k) for i, k in enumerate(self.kinds)]

    def write(self, *columns: np.ndarray) -> None:
        if sum(c.nbytes for c in columns) <= SPILL:
            self.held = list(columns)
            return
        self.held, self.folder = None, self.folder or tempfile.TemporaryDirectory(prefix="suffixes-")
        for i, c in enumerate(columns):
            c.tofile(os.path.join(self.folder.name, str(i)))

    def close(self) -> None:
        if self.folder:
            self.folder.cleanup()


def symbols(data: np.ndarray) -> np.ndarray:
    """Which bytes there are."""
    return np.flatnonzero(np.bincount(data, minlength=256)) if len(data) else np.zeros(0, int)


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, used: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, length, and common prefix (CAP at most) with the one before, of all suffixes in sorted order.

    data: bytes; text i is data[starts[i]:starts[i] + sizes[i]]; a suffix that is a prefix of another comes first,
    equal suffixes come in the order of texts. used: symbols(data), where it is known. Suffixes shorter than `least` are
    given as length 0 of text 0.
    """
    m, used = len(starts), symbols(data) if used is None else used
    kind = np.uint8 if len(used) < 256 else np.uint16
    code = np.zeros(256, kind)
    code[used] = np.arange(1, len(used) + 1)

    def symbol(texts: np.ndarray, length: int) -> np.ndarray:
        """What stands before the suffix of a length; 0 at the beginning."""
        at = sizes[texts] - length - 1
        return np.where(at >= 0, code[data[np.maximum(starts[texts] + at, 0)]], 0).astype(kind)

    files, texts, place, length = Files(kind), np.arange(m), np.arange(m), 0
    try:
        files.write(symbol(texts, 0), np.zeros(m + 1, np.uint8))  # prefixes have one place more, behind the last
        while True:
            alive = sizes[texts] > length
            texts, place = texts[alive], place[alive]
            if not len(texts):
                break
            transform, prefix = files.read()
            order, rank, done = _columns(transform)
            n, r = len(transform), rank[place]
            # m empty suffixes lead; texts that are complete have no further suffix
            new = m + r - done
            own = transform[place]
            earlier, later = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, n - 1)]
            # the smallest prefix from the equal symbol before on, and from here to the one behind, in one pass
            bounds = np.empty((len(texts), 3), np.int64)
            bounds[:, 0], bounds[:, 1], bounds[:, 2] = np.minimum(earlier, place) + 1, place + 1, np.maximum(later, place) + 1
            least_of = np.minimum.reduceat(prefix, bounds.ravel()).reshape(-1, 3).astype(np.int64)
            up = np.where((r > 0) & (transform[earlier] == own), 1 + least_of[:, 0], 0)
            down = np.where((r + 1 < n) & (transform[later] == own), 1 + least_of[:, 1], 0)
            total = n + len(texts)
            old = np.ones(total, bool)
            old[new] = False
            out = [np.empty(total, kind), np.empty(total + 1, np.uint8)]
            out[0][old], out[1][:total][old], out[1][total] = transform, prefix[:n], 0
            out[0][new] = symbol(texts, length + 1)
            # what follows a new suffix shares `down` with it; where that is new itself, its own `up` says the same
            inside = new + 1 < total
            out[1][new[inside] + 1] = np.minimum(down[inside], CAP)
            out[1][new] = np.minimum(up, CAP)
            files.write(*out)
            # in the order of places, which is that of symbols and then of the places before
            turn = np.argsort(own, kind="stable")
            texts, place, length = texts[turn], new[turn], length + 1
        transform, prefix = files.read()
    finally:
        files.close()
    # rows of a text's suffixes, from the empty one on, by the last transform
    order, rank, done = _columns(transform)
    number, lengths = np.zeros(len(transform), np.int32), np.zeros(len(transform), np.int32)
    row, texts, length = np.arange(m), np.arange(m), 0
    while len(texts):
        if length >= least:
            number[row], lengths[row] = texts, length
        more = sizes[texts] > length
        row, texts, length = m + rank[row[more]] - done, texts[more], length + 1
    return number, lengths, prefix[:-1]


def _columns(transform: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places by symbol, each place's rank in that order, and how many texts are complete."""
    order = np.argsort(transform, kind="stable")
    rank = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
    rank[order] = np.arange(len(order), dtype=rank.dtype)
    return order, rank, int(np.count_nonzero(transform == 0))
