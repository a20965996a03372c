"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE_WORDS words; its label belongs to the bag. Every
passage is encoded (hashed word embedding and surface measurements, then a learned tanh
layer), a gated attention gives each passage a weight from its encoding, and a logistic layer
scores the weighted sum. All layers are trained together in numpy on a bounded sample of
labelled rows. Scoring is one pass over the whole texts: every passage of a document is
encoded and weighted, whatever its length.

Defined cases: a null or empty text is one passage without words; copies score alike; without
labelled rows every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.arrays import LOWER, SPACE, Words, buffer, map_slices, mix, segment
from quaestor.llm.langid import fold

PASSAGE_WORDS = 64
BUCKETS = 1 << 12
WORD_DIM = 16
HIDDEN = 24
SAMPLE_ROWS = 8_000  # bound of the training sample
PREDICTED_FROM = 0.3
DECIMALS = 9
_PROJECTION = np.random.default_rng(11).normal(0, 1, (BUCKETS, WORD_DIM)).astype(np.float32)
FEATURES = WORD_DIM + 9


def _tables() -> np.ndarray:
    code = np.arange(256)
    mark = ((code > 32) & (code < 127)) & ~(((code | 32) >= 97) & ((code | 32) <= 122)) & ~((code >= 48) & (code < 58))
    return np.stack(
        [
            (code >= 65) & (code < 91),
            (code >= 48) & (code < 58),
            mark & ~np.isin(code, [44, 46]),
            code == 10,
            code >= 128,
        ]
    )


_KINDS = _tables()


def _encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and each text's first passage."""
    words = Words(data, offsets)
    n_texts = len(offsets) - 1
    hashes = words.hashes(LOWER[data]) if len(data) else np.zeros(0, np.uint64)
    n_passages = np.maximum(1, -(-words.counts // PASSAGE_WORDS))
    begin = np.concatenate([[0], np.cumsum(n_passages)])
    inside = np.arange(begin[-1]) - np.repeat(begin[:-1], n_passages)
    start = np.repeat(words.first[:-1], n_passages) + inside * PASSAGE_WORDS
    first = np.append(start, len(words.starts))
    sizes = np.diff(first)
    full = np.maximum(sizes, 1)[:, None].astype(np.float32)

    looked = _PROJECTION[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
    mean = segment(np.add, looked, first, 0) / full

    # byte range of each passage, empty ones at the end of the slice
    lo = np.append(words.starts, len(data))[first[:-1]]
    hi = np.where(sizes > 0, np.append(words.ends, 0)[np.maximum(first[1:] - 1, 0)], lo)
    per_word = []
    for kind in _KINDS:
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        per_word.append(total[hi] - total[lo])
    letters = np.concatenate([[0], np.cumsum(~SPACE[data], dtype=np.int64)])
    per_word.append(letters[hi] - letters[lo])

    owner = np.repeat(np.arange(begin[-1]), sizes)
    own_text = np.repeat(np.arange(n_texts), words.counts)
    again_here = _repeats(mix(hashes ^ owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    following = np.roll(hashes, -1)
    again_near = _repeats(mix(hashes + mix(following) + own_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    repeats = np.stack([again_here, again_near], axis=1).astype(np.float32)
    surface = np.concatenate(
        [
            np.log1p(np.stack(per_word, axis=1) / full),
            segment(np.add, repeats, first, 0) / full,
            np.log1p(sizes)[:, None] / 4,
        ],
        axis=1,
    )
    return np.concatenate([mean * 2, surface * 2], axis=1).astype(np.float32), begin


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Whether each key has an equal one."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(keys) else False
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Passage encoder, gated attention and logistic layer."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "encode": draw(FEATURES, HIDDEN), "encode_b": np.zeros(HIDDEN, np.float32),
            "value": draw(HIDDEN, HIDDEN), "gate": draw(HIDDEN, HIDDEN), "attend": draw(HIDDEN),
            "out": np.zeros(HIDDEN, np.float32), "out_b": np.zeros(1, np.float32),
        }
        self.mean = np.zeros(FEATURES, np.float32)
        self.scale = np.ones(FEATURES, np.float32)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p = self.p
        x = (x - self.mean) / self.scale
        z = np.tanh(x @ p["encode"] + p["encode_b"])
        t, s = np.tanh(z @ p["value"]), _sigmoid(z @ p["gate"])
        e = (t * s) @ p["attend"]
        sizes = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), sizes))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), sizes)
        m = np.add.reduceat(a[:, None] * z, first[:-1], axis=0)
        return {"x": x, "z": z, "t": t, "s": s, "a": a, "m": m, "y": _sigmoid(m @ p["out"] + p["out_b"])}

    def gradients(self, f: dict, first: np.ndarray, labels: np.ndarray) -> dict:
        p, n, sizes = self.p, len(labels), np.diff(first)
        d = (f["y"] - labels) / n
        g = {"out": f["m"].T @ d, "out_b": np.array([d.sum()])}
        dm = np.repeat(d[:, None] * p["out"], sizes, axis=0)
        da = (dm * f["z"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), sizes))
        g["attend"] = (f["t"] * f["s"]).T @ de
        du = de[:, None] * p["attend"]
        dt, ds = du * f["s"] * (1 - f["t"] ** 2), du * f["t"] * f["s"] * (1 - f["s"])
        g["value"], g["gate"] = f["z"].T @ dt, f["z"].T @ ds
        dz = (dm * f["a"][:, None] + dt @ p["value"].T + ds @ p["gate"].T) * (1 - f["z"] ** 2)
        g["encode"], g["encode_b"] = f["x"].T @ dz, dz.sum(axis=0)
        return g

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 24, rate: float = 0.01, seed: int = 3):
        """Adam over mini-batches of bags."""
        if not bags:
            return self
        rng = np.random.default_rng(seed)
        rows = np.concatenate(bags)
        self.mean, self.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-2
        one = {k: np.zeros_like(v) for k, v in self.p.items()}
        two = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), 128):
                at = order[k : k + 128]
                first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in at])])
                grads = self.gradients(self.forward(np.concatenate([bags[i] for i in at]), first), first, labels[at])
                step += 1
                for key, g in grads.items():
                    one[key] = 0.9 * one[key] + 0.1 * g
                    two[key] = 0.999 * two[key] + 0.001 * g * g
                    move = one[key] / (1 - 0.9**step) / (np.sqrt(two[key] / (1 - 0.999**step)) + 1e-8)
                    decayed = self.p[key] * (1 - 1e-4)
                    self.p[key] = (decayed - rate * (1 - epoch / epochs) * move).astype(np.float32)
        return self

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """In double precision and rounded, so that a text's score does not depend on the rows
        it is multiplied with."""
        return np.round(self.forward(x.astype(np.float64), first)["y"], DECIMALS)


def _bags(part: pa.RecordBatch) -> dict:
    """All passages of every text."""
    x, first = _encode(*buffer(part.column("text")))
    bags = [x[a:b].ravel() for a, b in zip(first[:-1], first[1:])]
    return {"quality": part.column("quality"), "bag": pa.array(bags, pa.list_(pa.float32()))}


def train(docs: DataFrame, labels: DataFrame, seed: int = 3) -> AttentionModel:
    """Fit on at most about SAMPLE_ROWS documents (`doc_id`, `text`) with a label (`doc_id`,
    `quality`), drawn by a hash of the id."""
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    total = known.count()
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))
    # both sides are cut to the drawn ids before they meet
    sample = docs.where(draw).select("doc_id", "text").join(known.where(draw), "doc_id").select("text", "quality")
    rows = map_slices(sample, _bags, "quality int, bag array<float>").toArrow()
    marks = (rows.column("quality").to_numpy() > 0).astype(int).tolist()
    bags = [b.values.to_numpy() for b in rows.column("bag")]
    pairs = sorted(zip(marks, bags), key=lambda r: (r[0], r[1].tobytes()))
    return AttentionModel(seed).fit([b.reshape(-1, FEATURES) for _, b in pairs], np.array([q for q, _ in pairs]))


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """`doc_id` and `score` of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> dict:
        x, first = _encode(*buffer(part.column("text")))
        return {"doc_id": part.column("doc_id"), "score": pa.array(model.score(x, first))}

    return map_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows outside the held-out fifth and score every row."""
    model = train(docs.where(fold(5) != 0), labels.where(fold(5) != 0))
    return score(docs, model).select(
        "doc_id",
        (fold(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"),
    )
