"""Vectorised text arithmetic shared by the operators: words, shingles and their hashes.

A slice of texts is one byte buffer with offsets, as Arrow delivers it. Everything here works
on whole slices; no loop runs per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quaestor.session import ship

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20

# \x20 and \x09-\x0D
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, _U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * SLICE_BYTES:  # a giant text's powers are not kept
            _powers[name] = have
    return have[:n]


class Rolling:
    """Hash of any range of a sequence of 64-bit codes in constant time."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.prefix = np.zeros(n + 1, _U)
        np.cumsum(codes * _power("up", _BASE, n), out=self.prefix[1:])
        self.down = _power("down", _BASE_INV, n + 1)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts])

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n codes from every position that has n."""
        size = max(0, len(self.prefix) - n)
        return mix((self.prefix[n:] - self.prefix[:size]) * self.down[:size])


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


class Words:
    """The words of a slice of texts: byte ranges, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
        inside = ~separator[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < offsets[1:]]  # texts do not run into each other
        begins[at] = inside[at]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[at[1:] - 1] = inside[at[1:] - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        return Rolling(_BYTE[data]).ranges(self.starts, self.ends)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words inside each text, and each text's first; a text of fewer
    words, but not none, has its whole sequence."""
    counts = np.diff(first)
    rolling = Rolling(words)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    position = np.arange(begin[-1]) - np.repeat(begin[:-1], n) + np.repeat(first[:-1], n)
    length = np.repeat(np.minimum(counts, k), n)
    # the length is part of the hash
    return mix(rolling.ranges(position, position + length) + length.astype(_U)), begin


def distinct_sorted(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every segment."""
    begin = np.asarray(first, np.int64) - first[0]
    out = values[first[0] : first[-1]].copy()
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[begin[:-1][begin[:-1] < len(out)]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[begin]


def segment(op, values: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    """`op.reduceat` over segments of which some may be empty."""
    out = np.full((len(first) - 1, *values.shape[1:]), empty, values.dtype)
    full = first[:-1] < first[1:]
    if full.any():
        out[full] = op.reduceat(values, first[:-1][full], axis=0)
    return out


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Segments as an Arrow list array of long."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))


def slices(batch: pa.RecordBatch, *texts: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `limit` bytes of text; a longer text is alone."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(t)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
    run = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(run)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def tuned(df):
    """`df`, in a session that has sent this package to the workers and bounds Arrow batches by
    bytes: texts may be long."""
    ship(df.sparkSession).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def map_slices(df, fn: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text"):
    """`mapInArrow` over slices; `fn` returns the output columns in the schema's order."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                out = fn(part)
                yield pa.record_batch(list(out.values()), names=list(out))

    return tuned(df).mapInArrow(run, schema)
