"""Fill-in-the-middle: texts cut at two token boundaries and written in another order.

The bytes of a slice of texts are classed by what they are (white space, first or later byte of
another character) and what follows. A wavelet matrix over the classes answers how many of a
class stand before any position. Ranks of the classes that end a token, added up, count the
boundaries before a position; ranks of the later bytes give its code points. Each cut is found
by bisection on the boundary counts, for all texts of the slice at once.

A token is a word with the white space before it; white space at the end is one token more.
The two cuts, whether to transform, and the order depend on the row's id only, through
sha256(seed:id). Texts that contain a sentinel stay plain, so outputs can be read back exactly.

Defined cases: a null text is empty; an empty text is plain with no tokens; a null id takes part
as the empty string; rows of one id are cut alike; a very long text is a slice of its own,
at some ten times its bytes; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.arrays import SPACE, buffer, map_slices

SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
# Fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Classes of bytes: what the byte is, and what follows it in its text.
SPACE_ON, SPACE_END, HEAD_ON, HEAD_SPACE, HEAD_END, TAIL_ON, TAIL_SPACE, TAIL_END = range(8)
BOUNDARIES = (SPACE_END, HEAD_SPACE, HEAD_END, TAIL_SPACE, TAIL_END)
TAILS = (TAIL_ON, TAIL_SPACE, TAIL_END)
BITS = 3
_ONES = np.array([(1 << k) - 1 for k in range(64)], np.uint64)


class _Bits:
    """A bit vector with its ones counted before any position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(packed) // 8 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _ONES[at & 63])


class WaveletMatrix:
    """A sequence of small symbols; `rank` counts one of them before any positions."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.levels: list[tuple[int, _Bits, int]] = []
        for shift in range(bits - 1, -1, -1):
            one = (symbols >> shift) & 1 == 1
            self.levels.append((shift, _Bits(one), int(len(one) - one.sum())))
            # stable: zeros, then ones
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        low, at = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for shift, bits, zeros in self.levels:
            if symbol >> shift & 1:
                low, at = zeros + bits.ones(low), zeros + bits.ones(at)
            else:
                low, at = low - bits.ones(low), at - bits.ones(at)
        return at - low

    def ranks(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte."""
    space = SPACE[data]
    follow = np.zeros(len(data), np.uint8)  # another character of a word, or more white space
    follow[:-1][space[1:] & ~space[:-1]] = 1
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    follow[ends] = 2
    tail = (data & 0xC0) == 0x80
    word = np.where(tail, TAIL_ON, HEAD_ON).astype(np.uint8) + follow
    return np.where(space, np.where(follow == 2, SPACE_END, SPACE_ON), word).astype(np.uint8)


class Boundaries:
    """Token counts and cuts of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.matrix = WaveletMatrix(classes(data, offsets))
        self.starts, self.ends = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        self.base = self.matrix.ranks(BOUNDARIES, self.starts)
        self.n = self.matrix.ranks(BOUNDARIES, self.ends) - self.base

    def cut(self, tokens: np.ndarray) -> np.ndarray:
        """Position after so many tokens of each text: the first with that many boundaries."""
        low, high = self.starts.copy(), self.ends.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.matrix.ranks(BOUNDARIES, middle) - self.base >= tokens
            high = np.where(enough, middle, high)
            low = np.where(enough, low, np.minimum(middle + 1, high))
        return low

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before positions."""
        return at - self.matrix.ranks(TAILS, at)


def _cut(part: pa.RecordBatch) -> dict:
    data, offsets = buffer(part.column("text"))
    found = Boundaries(data, offsets)
    h = [part.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
    x, y = h[0] % (found.n + 1), h[1] % (found.n + 1)
    first, second = found.cut(np.minimum(x, y)), found.cut(np.maximum(x, y))
    counts = [found.chars(at) for at in (found.starts, first, second)]
    raw = data.tobytes()
    signs = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    forms, outputs = [], []
    for i, (a, b, p, m) in enumerate(zip(found.starts.tolist(), found.ends.tolist(), first.tolist(), second.tolist())):
        text = raw[a:b]
        if not text or h[2][i] % 100 >= FIM_PERCENT or any(s in text for s in signs):
            forms.append("plain")
            outputs.append(text)
            continue
        prefix, middle, suffix = raw[a:p], raw[p:m], raw[m:b]
        if h[3][i] % 100 < SPM_PERCENT:
            forms.append("spm")
            outputs.append(b"".join((signs[1], suffix, signs[0], prefix, signs[2], middle)))
        else:
            forms.append("psm")
            outputs.append(b"".join((signs[0], prefix, signs[1], suffix, signs[2], middle)))
    plain = np.array([f == "plain" for f in forms], bool)
    return {
        "doc_id": part.column("doc_id"),
        "n": pa.array(found.n),
        "form": pa.array(forms, pa.string()),
        "prefix_chars": pa.array(counts[1] - counts[0], mask=plain),
        "middle_chars": pa.array(counts[2] - counts[1], mask=plain),
        "output": pa.array(outputs, pa.binary()).cast(pa.string()),
    }


def transform(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """`doc_id`, `n` tokens, `form` (plain, psm, spm), `prefix_chars`, `middle_chars`, `output` of
    every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sha2(key, 256).alias("_h"))
    groups = [F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_slices(hashed.select("doc_id", "text", *groups), _cut, schema)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from."""

    def between(start: str, end: str | None) -> Column:
        rest = F.substring_index(output, start, -1)
        return F.substring_index(rest, end, 1) if end else rest

    # each sentinel stands once, in a fixed order
    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
