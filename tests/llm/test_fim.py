"""Fill-in-the-middle against plain slicing, and the wavelet matrix against counting."""

import hashlib
import random
import re

import numpy as np
import pytest

from quaestor.llm import arrays, fim

from .common import DOCS, LONG, ODD, docs

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    key = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(3)
    parts = [" ", "\n", "\t\t", "a", "é", "\U0001f600", "word", "<", ">", "S>", "<S", "P", "M>", "\x85", " ", "\x00"]
    made = [(100 + k, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for k in range(400)]
    fixed = ["<P>", "a<S>b", "x <M>", "   ", "a", "a ", " a", "ends in <", "> starts <", "<S ><P", "tail \n \n"]
    return [*ODD, *made, *[(k, t) for t in fixed for k in range(20, 32)], (33, LONG + "é" * 5000 + LONG)]


def test_equals_plain_slicing(spark):
    given = rows()
    out = fim.transform(docs(spark, given, extra=True))
    back = out.withColumn("back", fim.restore(out["output"], out["form"])).collect()
    assert sorted((tuple(r)[:6] for r in back), key=repr) == sorted((plain(i, t) for i, t in given), key=repr)
    assert sorted(r.back for r in back) == sorted(t or "" for _, t in given)
    assert {r.form for r in back} == {"plain", "spm", "psm"}


def test_tiny_slices(spark, monkeypatch):
    given = rows()[:120]
    import pyarrow as pa

    table = pa.table({"text": pa.array([t for _, t in given])})
    data, offsets = arrays.buffer(table.column("text").combine_chunks())
    found = fim.Boundaries(data, offsets)
    assert found.n.tolist() == [len(TOKEN.findall(t or "")) for _, t in given]


def test_empty(spark):
    assert fim.transform(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_ranks(n):
    symbols = np.random.default_rng(n).integers(0, 8, n).astype(np.uint8)
    matrix = fim.WaveletMatrix(symbols)
    for symbol in range(8):
        want = np.concatenate([[0], np.cumsum(symbols == symbol)])
        assert matrix.rank(symbol, np.arange(n + 1)).tolist() == want.tolist()
