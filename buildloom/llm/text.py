"""Vectorised words and shingles over Arrow string columns: no Python string is made.

Words are the runs of bytes other than ASCII white space. A word's hash is a polynomial hash of its bytes modulo 2^64
(each byte first replaced by a random 64-bit number), finalised with its length; a shingle's hash combines its words'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20260530))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_M = 0x9E3779B97F4A7C15
_M_INV = pow(_M, -1, 1 << 64)
_MIX = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Bytes of text that are hashed at once (a longer document makes a larger piece of its own).
PIECE = 2_000_000
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > 4 * PIECE:
        keep = None
    else:
        keep = _POWERS
    if keep is not None and keep and len(keep["up"]) >= n:
        return keep["up"], keep["down"]
    m = max(n, PIECE)
    up, down = np.full(m, U(_M)), np.full(m, U(_M_INV))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        up, down = np.cumprod(up), np.cumprod(down)
    if keep is not None:
        keep |= {"up": up, "down": down}
    return up, down


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets (int64, one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def pieces(offs: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have most bytes together, or one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True, space: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows that offs delimits: each word's row, hash, first byte and end, in order. space: which bytes part words."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, np.zeros(0, np.uint64), e, e
    solid = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[offs[:-1]] = True  # a row's first byte starts a word, whatever ends the row before
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    nxt = np.zeros(n, bool)
    nxt[: n - 1] = edge[1:n]
    end = np.flatnonzero(solid & (~after | nxt)) + 1
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        run = np.empty(n + 1, np.uint64)
        run[0] = 0
        np.cumsum((_LOWER if lower else _TABLE)[data] * up[:n], out=run[1:])
        h = (run[end] - run[start]) * down[start]
        h = mix(h ^ ((end - start).astype(np.uint64) * U(_M)))
    row = np.searchsorted(offs, start, "right") - 1
    return row, h, start, end


def shingles(row: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each k words in a row, by the first word's position; none of a row with fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        s = np.zeros(n, np.uint64)
        for j in range(k):
            s += h[j : n + j] * _MIX[j]
        s = mix(s)
    whole = row[:n] == row[k - 1 :]
    return np.where(whole, row[:n], -1), s


def shingle_sets(row: np.ndarray, h: np.ndarray, k: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row, sorted by row and hash. A row of 1 to k-1 words has one shingle: all of them."""
    r, s = shingles(row, h, k)
    ok = r >= 0
    r, s = r[ok], s[ok]
    count = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    brief = np.flatnonzero((count > 0) & (count < k))
    if len(brief):
        first = np.searchsorted(row, brief)
        extra = np.zeros(len(brief), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k - 1):
                there = count[brief] > j
                extra[there] += h[first[there] + j] * _MIX[j]
            extra = mix(extra ^ mix(count[brief].astype(np.uint64)))
        r, s = np.concatenate([r, brief]), np.concatenate([s, extra])
    order = np.lexsort((s, r))
    r, s = r[order], s[order]
    if len(r):
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
        r, s = r[new], s[new]
    return r, s
