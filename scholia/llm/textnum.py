"""Vectorised text primitives shared by the operators: word and line splitting, hashes of words and n-grams.

Everything works on UTF-8 bytes. Texts are joined into buffers of at most PIECE bytes (a longer text is
cut at a separator byte), so memory stays bounded however long a document is. A hash of a token depends on
its bytes alone, never on its place, so hashes agree between tasks, buffers and machines.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
U64 = np.uint64
_BASE, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)

#: Words as maximal runs of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Words as maximal runs of what isn't ASCII white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


#: Numbers mixed at a time: a block and its shifted copy stay in a core's cache.
_BLOCK = 1 << 14


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    out = np.array(h, U64, order="C")
    flat, shifted = out.reshape(-1), np.empty(min(out.size, _BLOCK), U64)
    for a in range(0, len(flat), _BLOCK):
        x = flat[a : a + _BLOCK]
        t = shifted[: len(x)]
        x ^= np.right_shift(x, U64(30), out=t)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= np.right_shift(x, U64(27), out=t)
        x *= U64(0x94D049BB133111EB)
        x ^= np.right_shift(x, U64(31), out=t)
    return out


def eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf on as one number (zeros beyond its end); a view, read where it is indexed."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


#: _LOW[n] keeps the first n bytes of eight.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 256


def substring(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end], by their bytes alone: eight at a time, each step mixed. Up to eight bytes never collide with as many."""
    import xxhash

    n, view = end - start, eight(buf)
    out = mix((view[start] & _LOW[np.minimum(n, 8)]) + mix(n.astype(U64) * _BASE))
    rest = np.flatnonzero((n > 8) & (n <= _LONG))
    done = 8
    while len(rest):
        left = n[rest] - done
        out[rest] = mix(out[rest] * _STEP ^ view[start[rest] + done] & _LOW[np.minimum(left, 8)])
        rest, done = rest[left > 8], done + 8
    for i in np.flatnonzero(n > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]].tobytes())
    return out


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOWER[buf]


def bounds(buf: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that `word` marks."""
    edge = np.diff(np.r_[False, word[buf], False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pieces(texts: list[bytes], word: np.ndarray, limit: int = PIECE):
    """Yield (buffer, [(text index, where it starts in the buffer)]); no word is cut by a buffer's end."""
    held: list[bytes] = []
    at: list[tuple[int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield np.frombuffer(b"".join(held), np.uint8), at
            held, at, size = [], [], 0
        start = 0
        while len(text) - start > limit:
            end = start + limit
            window = np.frombuffer(text, np.uint8, end - start, start)
            cut = np.flatnonzero(~word[window])
            if len(cut):
                end = start + int(cut[-1]) + 1
            else:
                after = np.flatnonzero(~word[np.frombuffer(text, np.uint8, len(text) - end, end)])
                end = end + int(after[0]) + 1 if len(after) else len(text)
            yield np.frombuffer(text, np.uint8, end - start, start), [(i, 0)]
            start = end
        at.append((i, size))
        held += [text[start:], b"\n"]
        size += len(text) - start + 1
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), at


def word_hashes(texts: list[bytes], word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and offsets: text i has hashes[offsets[i]:offsets[i + 1]]."""
    out, counts = [], np.zeros(len(texts), np.int64)
    for buf, at in pieces(texts, word):
        if lower:
            buf = lowered(buf)
        s, e = bounds(buf, word)
        out.append(substring(buf, s, e))
        ids, starts = np.array([x for x, _ in at]), np.array([x for _, x in at])
        np.add.at(counts, ids, np.diff(np.r_[np.searchsorted(s, starts), len(s)]))
    return np.concatenate(out) if out else np.zeros(0, U64), np.r_[0, np.cumsum(counts)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive items; the result is n - 1 shorter."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for i in range(n):
        out = out * _STEP + h[i : i + m]
    return mix(out)


def grams_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """grams(h, n)[at]."""
    out = np.zeros(len(at), U64)
    for i in range(n):
        out = out * _STEP + h[at + i]
    return mix(out)


def within(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the grams() over all texts' items lie in one text."""
    ok = np.ones(max(total - n + 1, 0), bool)
    for back in range(1, n):
        bad = offsets[1:-1] - back
        ok[bad[(bad >= 0) & (bad < len(ok))]] = False
    return ok


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values; the result is w - 1 shorter."""
    if len(a) < w:
        return a[:0]
    size = 1
    while size * 2 <= w:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    rest = w - size
    return np.minimum(a[:-rest], a[rest:]) if rest else a


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def slices(texts: list[bytes], limit: int = PIECE // 2):
    """Ranges (a, b) of texts that hold `limit` bytes together, or one text."""
    a = size = 0
    for i, text in enumerate(texts):
        if i > a and size + len(text) > limit:
            yield a, i
            a, size = i, 0
        size += len(text)
    if a < len(texts):
        yield a, len(texts)


def _trimmer():
    """Gives memory that was freed back to the system, where the C library can; workers live on between tasks."""
    import ctypes

    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda: None
    return lambda: trim(0)


_trim = _trimmer()


def as_bytes(column) -> list[bytes]:
    """An Arrow binary or string column as bytes; null as empty. Called once for each batch."""
    _trim()
    return [b"" if x is None else x if isinstance(x, bytes) else x.encode() for x in column.to_pylist()]
