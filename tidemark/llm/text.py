"""Word and n-gram hashing over Arrow text columns.

The functions work on whole blocks of documents with numpy: a block is a run
of rows whose texts hold about a megabyte (a longer text is a block of its
own), so memory follows the longest text and not the batch. No text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = np.asarray(x, dtype=_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTE = seeded(256, 11)
_BASE = _U(0x9E3779B97F4A7C15) | _U(1)
_WORD_BASE = _U(0xD1342543DE82EF95)
_powers = np.ones(1, dtype=_U)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 4096)
        _powers = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, _BASE, _U)]), dtype=_U)
    return _powers


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and the value of each."""

    member: np.ndarray
    value: np.ndarray


def alphabet(separators: bytes, fold_case: bool) -> Alphabet:
    member = np.ones(256, dtype=bool)
    member[list(separators)] = False
    value = _BYTE.copy()
    if fold_case:
        value[65:91] = value[97:123]
    return Alphabet(member, value)


SPACES = b" \t\n\x0b\x0c\r"
#: Words between ASCII white space, as written and with A-Z lowered.
WORDS = alphabet(SPACES, fold_case=False)
WORDS_FOLDED = alphabet(SPACES, fold_case=True)
#: Words of ASCII letters, digits and all non-ASCII characters, A-Z lowered.
ALNUM_FOLDED = alphabet(bytes(b for b in range(128) if not chr(b).isalnum()), fold_case=True)


@dataclass(frozen=True)
class Block:
    """Documents ``first`` to ``last`` of a batch: their bytes and offsets."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def __len__(self) -> int:
        return self.last - self.first


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(what, dtype=np.uint8) if what is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        own = offsets[first : last + 1]
        yield Block(first, last, data[own[0] : own[-1]], own - own[0])
        first = last


@dataclass(frozen=True)
class Tokens:
    """Words of a block: byte starts and ends, 64-bit hashes, and for each
    document the range ``bounds[i]:bounds[i + 1]`` of its words."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay in one document."""
    n = len(inside)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def tokens(block: Block, kind: Alphabet) -> Tokens:
    inside = kind.member[block.data]
    starts, ends = runs(inside, block.offsets)
    bounds = np.searchsorted(starts, block.offsets)
    if len(starts) == 0:
        return Tokens(starts, ends, np.empty(0, _U), bounds)
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], lengths)
    values = kind.value[block.data[inside]] * powers(int(lengths.max()))[place]
    return Tokens(starts, ends, mix(np.add.reduceat(values, at[:-1]) + lengths.astype(_U)), bounds)


def grams(hashes: np.ndarray, bounds: np.ndarray, k: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word windows and the place of their first word.

    With ``whole_if_short`` a document of fewer words, but not none, has its
    whole sequence as one window. Windows stay within a document.
    """
    n = len(hashes)
    sizes = np.diff(bounds)
    total = np.zeros(max(0, n - k + 1), dtype=_U)
    for j in range(k if len(total) else 0):
        total = total * _WORD_BASE + hashes[j : j + len(total)]
    room = np.repeat(bounds[1:], sizes) - np.arange(n)
    first = np.flatnonzero(room[: len(total)] >= k)
    out = mix(total[first] + _U(k))
    if whole_if_short:
        short = np.flatnonzero((sizes > 0) & (sizes < k))
        if len(short):
            acc = np.zeros(len(short), dtype=_U)
            for j in range(k - 1):
                has = sizes[short] > j
                acc[has] = acc[has] * _WORD_BASE + hashes[bounds[short[has]] + j]
            out = np.concatenate([out, mix(acc + sizes[short].astype(_U))])
            first = np.concatenate([first, bounds[short]])
            order = np.argsort(first, kind="stable")
            out, first = out[order], first[order]
    return out, first


def distinct_within(values: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Places of the first of each value within its document, ascending."""
    if len(values) == 0:
        return np.empty(0, dtype=np.int64)
    _, index = np.unique(values ^ mix(document.astype(_U) + _U(77)), return_index=True)
    return np.sort(index)


def sums_by_document(values: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    """Wrapping sums of 64-bit values by ascending document number."""
    out = np.zeros(n, dtype=_U)
    if len(values):
        starts = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]]))
        out[document[starts]] = np.add.reduceat(values, starts)
    return out


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == _U else x.astype(np.int64))


def code_points_before(data: bytes, at: int) -> int:
    """How many code points of UTF-8 ``data`` begin before byte ``at``."""
    return len(data[:at].decode("utf-8", "replace"))
