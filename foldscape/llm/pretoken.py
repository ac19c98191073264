"""The public split pattern of the byte-level vocabularies, over whole chunks at once.

The pattern takes, at each place, the first of: 's 't 're 've 'm 'll 'd; letters,
numbers, or other visible characters, each with one space before them if there is
one; white space, without its last character if something visible follows; white
space. All of it depends on the class of each character and on where runs of a
class begin, so the split is a few array operations instead of a match a token.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex

from foldscape.llm.common import flat, mixed, powers, ragged

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The code points of Unicode's White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe to make a token of its own.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start()] : points[m.end() - 1] + 1] = kind
    out[WHITE_SPACE] = SPACE
    return out


def split(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts; where each token starts in them; n + 1 counts of tokens before each text."""
    raw, offsets = flat(texts)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    bounds = lead[offsets]
    n = len(points)
    if not n:
        return points, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    kind = classes()[points]
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # white space before something visible: its last character stands alone, or goes with what follows
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # contractions: an apostrophe that starts a token, right before letters
    mark = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~edge[1:n])
    if len(mark):
        one = points[mark + 1]
        two = np.where(mark + 2 < n, points[np.minimum(mark + 2, n - 1)], 0)
        two = np.where(edge[np.minimum(mark + 2, n)], 0, two)
        size = np.zeros(len(mark), np.int64)
        for c in CONTRACTIONS:
            hit = (one == ord(c[0])) & ((two == ord(c[1])) if len(c) == 2 else True)
            size[hit & (size == 0)] = len(c)
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        rest = mark + 1 + size
        start[rest[rest < n]] = True
    starts = np.flatnonzero(start)
    return points, starts, np.searchsorted(starts, bounds)


class Words:
    """Tokens of the split seen by this Python worker, by hash, with what encodes them.

    encode() turns new words into lists of ids. At LIMIT words it starts afresh, so
    its memory is bounded; what is held never changes a result.
    """

    LIMIT = 1_500_000

    def __init__(self, encode, reserved: tuple[int, ...] = ()):
        self.encode, self.reserved = encode, np.array(reserved, np.uint32)
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.places = np.zeros(0, np.int64)
        self.ids = self.reserved
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def look(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The place in begin and size of each token."""
        import pandas as pd

        if not len(starts):
            return np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(points)))
        place = np.arange(len(points)) - np.repeat(starts, lengths)
        terms = mixed(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * powers(int(lengths.max()))[place]
        h = mixed(np.add.reduceat(terms, starts) + lengths.astype(np.uint64))
        codes, unique = pd.factorize(h)
        if len(self.hashes) + len(unique) > self.LIMIT:
            self.clear()
        at = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == unique[inside]
        if not known.all():
            fresh = np.flatnonzero(~known)
            first = np.zeros(len(unique), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            spans = first[fresh]
            text = points[ragged(starts[spans], lengths[spans])].tobytes().decode("utf-32-le")
            ends = np.cumsum(lengths[spans]).tolist()
            begins = [0, *ends[:-1]]
            ids, sizes = self.encode([text[a:b] for a, b in zip(begins, ends, strict=True)])
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.ids = np.concatenate([self.ids, ids])
            order = np.argsort(unique[fresh])
            into = at[fresh][order]
            self.places = np.insert(self.places, into, len(self.places) + order)
            self.hashes = np.insert(self.hashes, into, unique[fresh][order])
            at = np.searchsorted(self.hashes, unique)
        return self.places[at][codes]
