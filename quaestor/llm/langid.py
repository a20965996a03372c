"""Language identification: averaged hashed subword embeddings under a linear softmax.

Every run of 2, 3 and 4 bytes of the lower-cased text is hashed to one of `BUCKETS` embedding
rows. The text's vector is their average, a linear layer gives one logit per language. Both
layers are trained by stochastic gradient descent in numpy on a bounded sample of rows, each with
all of its subwords as counts per bucket; the step follows the gradient of the average. A
temperature and a rejection threshold are then fitted on sample rows that training did not see.

Average and linear layer commute, so scoring looks up one logit row per subword and never
forms the embedding: the cost is linear in the bytes, the state a table of BUCKETS x languages.

Defined cases: a null text or one without a letter is `und` with score 0 and is rejected; texts
of one byte count as one subword; without any labelled row every text is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.arrays import LOWER, Rolling, _BYTE, buffer, map_slices, segment

BUCKETS = 1 << 15
DIM = 16
ORDERS = (2, 3, 4)
NAMES_BYTES = 8 << 20  # of distinct languages that may be broadcast
SAMPLE_PER_LANGUAGE = 600  # about; with SAMPLE_ROWS the bound of the training sample
SAMPLE_ROWS = 6_000
CHUNK = 1 << 18  # subwords looked up at a time
EMBEDDING_RATE = 400  # times the layer's
REJECTED_SHARE = 0.0005  # of right calibration rows that the threshold may cost


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: logits of one subword
    temperature: float
    threshold: float


def _grams(data: np.ndarray, offsets: np.ndarray):
    """Bucket numbers of all subwords of each order, with each text's first and last."""
    rolling = Rolling(_BYTE[LOWER[data]])
    sizes = np.diff(offsets)
    for n in ORDERS:
        buckets = (rolling.grams(n) & np.uint64(BUCKETS - 1)).astype(np.int32)
        yield buckets, offsets[:-1], np.maximum(offsets[1:] - n + 1, offsets[:-1])
    short = np.flatnonzero((sizes > 0) & (sizes < ORDERS[0]))
    one = (rolling.ranges(offsets[short], offsets[short + 1]) & np.uint64(BUCKETS - 1)).astype(np.int32)
    begins = np.searchsorted(short, np.arange(len(sizes) + 1))
    yield one, begins[:-1], begins[1:]


def _sample_rows(part: pa.RecordBatch) -> dict:
    """Every row's buckets and how often each occurs, over the whole text."""
    data, offsets = buffer(part.column("text"))
    grams = list(_grams(data, offsets))
    found = [np.unique(np.concatenate([x[a[i] : b[i]] for x, a, b in grams]), return_counts=True) for i in range(part.num_rows)]
    return {
        "lang": part.column("lang"),
        "buckets": pa.array([x.astype(np.int32) for x, _ in found], pa.list_(pa.int32())),
        "counts": pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32())),
    }


def _sums(table: np.ndarray, buckets: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Table rows of each text's subwords added up, so many subwords at a time."""
    out = np.zeros((len(begins), table.shape[1]))
    for low in range(0, len(buckets), CHUNK):
        high = min(low + CHUNK, len(buckets))
        looked = np.concatenate([table[buckets[low:high]], np.zeros((1, table.shape[1]), np.float32)])
        near = slice(np.searchsorted(ends, low, "right"), np.searchsorted(begins, high, "left"))
        # segments begin..end leave out the subwords that run into the next text
        cuts = np.clip(np.stack([begins[near], ends[near]], axis=1), low, high).ravel() - low
        if len(cuts):
            out[near] += segment(np.add, looked, np.append(cuts, len(looked)), 0)[0::2]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


Row = tuple[str, np.ndarray, np.ndarray]  # language, buckets, counts


def averages(rows: list[Row]) -> np.ndarray:
    """Share of every bucket in each row's subwords."""
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (_, buckets, counts) in enumerate(rows):
        x[i, buckets] = counts / counts.sum()
    return x


def gradients(x: np.ndarray, y: np.ndarray, embedding: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean cross entropy, by both layers."""
    hidden = x @ embedding
    error = _softmax(hidden @ weight)
    error[np.arange(len(y)), y] -= 1
    error /= len(y)
    return x.T @ (error @ weight.T), hidden.T @ error


def fit(rows: list[Row], epochs: int = 8, rate: float = 2.0, seed: int = 1) -> LanguageModel:
    """Train on rows; every fifth calibrates. An embedding row moves by its share of a text, so the
    embedding's rate is that much larger than the layer's."""
    rows = sorted((r for r in rows if len(r[1])), key=lambda r: (r[0], blake2b(r[1].tobytes() + r[2].tobytes()).digest()))
    languages = sorted({r[0] for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(r[0]) for r in rows])
    held = np.zeros(len(rows), bool)
    held[rng.permutation(len(rows))[::5]] = len(rows) >= 50
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32)
    train = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(train)
        for k in range(0, len(order), 32):
            at = order[k : k + 32]
            by_embedding, by_weight = gradients(averages([rows[i] for i in at]), y[at], embedding, weight)
            embedding -= step * EMBEDDING_RATE * by_embedding
            weight -= step * by_weight
    table = (embedding @ weight).astype(np.float32)

    check = np.flatnonzero(held) if held.any() else train
    logits = np.stack([rows[i][2] @ table[rows[i][1]] / rows[i][2].sum() for i in check]).astype(np.float64)
    scales = np.geomspace(0.05, 4, 60)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in scales]
    temperature = float(scales[int(np.argmin(loss))])
    p = _softmax(logits / temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[check]])
    threshold = float(right[int(len(right) * REJECTED_SHARE)]) if len(right) else 0.0
    # never stricter than an even bet between two languages
    return LanguageModel(languages, table, temperature, min(threshold, 0.5))


def train(labelled: DataFrame, seed: int = 1) -> LanguageModel:
    """Fit on at most about SAMPLE_PER_LANGUAGE rows (`text`, `lang`, `doc_id`) of each language, and
    about SAMPLE_ROWS in all, drawn by a hash of the id."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    drawn, size = sizes.agg(F.sum(F.least("_n", F.lit(SAMPLE_PER_LANGUAGE))), F.sum(F.octet_length("lang") + 16)).first()
    drawn, size = drawn or 0, size or 0
    each = SAMPLE_PER_LANGUAGE * min(1.0, SAMPLE_ROWS / max(drawn, 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    # texts do not move for the draw, unless there are too many languages to send to every task
    chosen = rows.join(F.broadcast(sizes) if size <= NAMES_BYTES else sizes, "lang").where(draw < F.lit(each) / F.col("_n")).select("text", "lang")
    sample = map_slices(chosen, _sample_rows, "lang string, buckets array<int>, counts array<int>").toArrow()
    lists = [[x.values.to_numpy() for x in sample.column(c)] for c in ("buckets", "counts")]
    return fit(list(zip(sample.column("lang").to_pylist(), *lists)), seed=seed)


def predict(docs: DataFrame, model: LanguageModel, carry: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """`carry` columns, `lang_pred`, `score` (calibrated probability), `rejected`; the three
    under names with `prefix`, where carried columns could clash."""
    fields = docs.select(*carry).schema.fields
    languages = np.array([*model.languages, "und"], object)

    def score(part: pa.RecordBatch) -> dict:
        data, offsets = buffer(part.column("text"))
        n, k = part.num_rows, len(model.languages)
        total, count = np.zeros((n, k)), np.zeros(n)
        for buckets, a, b in _grams(data, offsets):
            if not len(buckets) or not k:
                continue
            total += _sums(model.table, buckets, a, b)
            count += b - a
        p = _softmax(total / np.maximum(count, 1)[:, None] / model.temperature) if k else np.zeros((n, 1))
        letter = ((data | 32) - 97 < 26).astype(np.int64)
        has = segment(np.add, letter, offsets, 0) > 0
        for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
            has[i] = any(map(str.isalpha, part.column("text")[int(i)].as_py()))
        has &= k > 0
        top = np.where(has, p.argmax(axis=1), k)
        best = np.where(has, p.max(axis=1), 0.0)
        return {c: part.column(c) for c in carry} | {
            f"{prefix}lang_pred": pa.array(languages[top], pa.string()),
            f"{prefix}score": pa.array(best),
            f"{prefix}rejected": pa.array(~has | (best < model.threshold)),
        }

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_slices(
        docs.select(*dict.fromkeys((*carry, "text"))),
        score,
        f"{schema}, {prefix}lang_pred string, {prefix}score double, {prefix}rejected boolean",
    )


def fold(modulus: int) -> Column:
    """crc32 of the id's text modulo `modulus`; 0 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out quarter and predict every row."""
    model = train(docs.where(fold(4) != 2))
    return predict(docs, model).withColumn("held_out", fold(4) == 2)
