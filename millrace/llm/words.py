"""Words of texts as 64-bit hashes, cut in Arrow batches, and rolling hashes over runs of them."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What is taken out before words are cut: tags in angle or square brackets, and character entities.
MARKUP = r"<[^<>]*>|\[[^\[\]]*\]|&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_markup = re.compile(MARKUP)

#: Bytes of text that are worked on at a time; a longer text is a piece of its own.
PIECE = 1 << 20
#: Code points from here on are no letters or digits.
_LAST = 0x40000


@functools.cache
def _letters() -> np.ndarray:
    """For every code point 0 if it is neither letter nor digit, else a random-looking number of its lower case."""
    low = np.zeros(_LAST, np.uint64)
    for c in range(_LAST):
        ch = chr(c)
        if ch.isalpha() or ch.isdecimal():
            low[c] = ord(ch.lower()[0])
    mixed = (low + np.uint64(1)) * _P
    mixed ^= mixed >> np.uint64(29)
    mixed = (mixed * _Q) | np.uint64(1)
    return np.where(low > 0, mixed, np.uint64(0))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2⁶⁴."""
    back = np.uint64(pow(int(_P), -1, 2**64))
    up, down = np.full(n, _P), np.full(n, back)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def plain(text: str) -> str:
    """The text with a space for each piece of markup."""
    return _markup.sub(" ", text) if "<" in text or "[" in text or "&" in text else text


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first, hashes, sizes`` for one piece of a batch after the other: the words of some texts in a row.

    Words are maximal runs of letters and digits, compared without case, after markup is taken out; NULL and empty
    texts have none. ``first`` is the place of the piece's first text, ``sizes`` has a number of words for each of its
    texts. A piece is about a megabyte of texts, or one longer text, so memory doesn't grow with the batch. Equal words
    have equal hashes; others share one with a chance of about 2⁻⁶⁴.
    """
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, total = 0, np.cumsum(size)
    while first < len(texts):
        upto = total[first] - size[first] + PIECE
        end = max(first + 1, int(np.searchsorted(total, upto, "right")))
        yield first, *_words([plain(t) if t else "" for t in texts.slice(first, end - first).to_pylist()])
        first = end


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "\n".join(texts)
    if joined.isascii():
        code = np.frombuffer(joined.encode("ascii"), np.uint8)
    else:
        code = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.uint32(_LAST - 1))
    hashes, starts, at = [], [], 0
    while at < len(code):  # a long text in parts, cut where no word stands
        end = min(len(code), at + PIECE)
        mixed = _letters().take(code[at:end])
        if end < len(code):
            gaps = np.flatnonzero(mixed == 0)
            if not len(gaps):  # one word fills the part: take all of it
                rest = np.flatnonzero(_letters().take(code[end:]) == 0)
                end = end + int(rest[0]) if len(rest) else len(code)
                mixed = _letters().take(code[at:end])
            else:
                end = at + int(gaps[-1]) + 1
                mixed = mixed[: end - at]
        inside = np.zeros(len(mixed) + 2, bool)
        inside[1:-1] = mixed != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        a, b = edges[::2], edges[1::2]
        up, down = _powers(PIECE) if len(mixed) <= PIECE else _powers.__wrapped__(len(mixed))
        sums = np.zeros(len(mixed) + 1, np.uint64)
        np.cumsum(mixed * up[: len(mixed)], out=sums[1:])
        h = (sums[b] - sums[a]) * down[a]
        h ^= h >> np.uint64(32)
        hashes.append(h * _Q)
        starts.append(a + at)
        at = end
    begin = np.cumsum([0, *map(len, texts)]) + np.arange(len(texts) + 1)
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    where = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return flat, np.diff(np.searchsorted(where, begin))


def windows(v: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``n`` values modulo 2⁶⁴; empty if there are fewer."""
    if len(v) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(v) - n + 1, np.uint64)
    for k in range(n):
        h = h * _P + v[k : len(v) - n + 1 + k]
    return h


class Roller:
    """Hashes of runs of any length over one sequence, each length in one vector operation."""

    def __init__(self, v: np.ndarray) -> None:
        self.v, self.size = v, len(v)
        self.by_length: dict[int, np.ndarray] = {1: v}

    def of(self, n: int) -> np.ndarray:
        """Runs of ``n`` from runs of half that length."""
        if self.size < n:
            return np.empty(0, np.uint64)
        if n not in self.by_length:
            a = n // 2
            left, right = self.of(a), self.of(n - a)
            m = self.size - n + 1
            self.by_length[n] = left[:m] * _power(n - a) + right[a : a + m]
        return self.by_length[n]


@functools.lru_cache(4096)
def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_P), n, 2**64))
