"""Quality scores from a byte-level convolutional network, in numpy.

The bytes of a text are cut into overlapping chunks that cover all of it. Learned filters run over the embedded bytes of
each chunk and keep their strongest answer; mean and maximum of those over the chunks make one probability.

The network is fitted on a bounded sample, ``SAMPLE`` labelled documents (expected number, chosen by a hash of the id),
and then applied to every whole text.

Nulls and odd input: labels that are null, or not 0 or 1, are not learned from; of several labels of one id the largest
counts; a null text is an empty one, which is scored like any other; without any labels every score is 0.5; repeated rows
get equal scores; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, STEP = 512, 480
WIDTH, STRIDE, EMBED, FILTERS = 8, 2, 6, 24
SAMPLE = 3000
#: Chunks that are worked on at a time.
_BLOCK = 192
PLACES = (CHUNK - WIDTH) // STRIDE + 1

Model = dict[str, np.ndarray]


def chunks_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, the last filled up with zeros, and how many filter places of each row hold text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-max(0, len(raw) - CHUNK) // STEP) + 1)
    rows = np.zeros((n, CHUNK), np.uint8)
    sizes = np.empty(n, np.int64)
    for k in range(n):
        part = raw[k * STEP : k * STEP + CHUNK]
        rows[k, : len(part)] = part
        sizes[k] = len(part)
    return rows, np.clip((sizes - WIDTH) // STRIDE + 1, 1, PLACES)


def start(seed: int = 5) -> Model:
    draw = np.random.default_rng(seed)
    f = lambda *shape, scale: (draw.standard_normal(shape) * scale).astype(np.float32)
    return {"embed": f(256, EMBED, scale=0.5), "filters": f(WIDTH * EMBED, FILTERS, scale=0.2), "bias": np.zeros(FILTERS, np.float32), "mean": f(FILTERS, scale=0.1), "max": f(FILTERS, scale=0.1), "level": np.zeros(1, np.float32)}


def _pooled(rows: np.ndarray, places: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per chunk and filter: the strongest answer and its place."""
    flat = model["embed"][rows].reshape(len(rows), CHUNK * EMBED)
    windows = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
    out = (np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ model["filters"]).reshape(len(rows), PLACES, FILTERS)
    short = np.flatnonzero(places < PLACES)
    for k in short:
        out[k, places[k] :] = -np.inf
    at = out.argmax(axis=1)
    return np.take_along_axis(out, at[:, None, :], axis=1)[:, 0] + model["bias"], at


def _combined(pooled: np.ndarray, first: np.ndarray, model: Model) -> tuple[np.ndarray, ...]:
    """Scores of documents whose chunks begin at ``first``, with what the gradients need."""
    live = np.maximum(pooled, 0)
    counts = np.diff(np.append(first, len(live)))[:, None].astype(np.float32)
    mean, most = np.add.reduceat(live, first) / counts, np.maximum.reduceat(live, first)
    logit = mean @ model["mean"] + most @ model["max"] + model["level"][0]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), live, mean, most, counts


def fitted(texts: list[str], labels: np.ndarray, epochs: int = 16, batch: int = 32) -> Model:
    """Adam on the log loss. Gradients reach the filters only where a chunk's strongest answer came from."""
    model, draw = start(), np.random.default_rng(11)
    held = [chunks_of(t) for t in texts]
    model["level"][0] = np.log(max(labels.mean(), 1e-3) / max(1 - labels.mean(), 1e-3))
    moments, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}, 0
    for epoch in range(epochs):
        for part in np.array_split(draw.permutation(len(texts)), max(1, len(texts) // batch)):
            step += 1
            rows, places = np.concatenate([held[k][0] for k in part]), np.concatenate([held[k][1] for k in part])
            first = np.concatenate([[0], np.cumsum([len(held[k][0]) for k in part])[:-1]])
            pieces = [_pooled(rows[a : a + _BLOCK], places[a : a + _BLOCK], model) for a in range(0, len(rows), _BLOCK)]
            pooled, at = np.concatenate([p for p, _ in pieces]), np.concatenate([p for _, p in pieces])
            score, live, mean, most, counts = _combined(pooled, first, model)
            off = ((score - labels[part]) / len(part)).astype(np.float32)
            owner = np.repeat(np.arange(len(part)), counts[:, 0].astype(int))
            top = live == most[owner]
            back = off[owner, None] * (model["mean"] / counts[owner] + model["max"] * top / np.maximum(1, np.add.reduceat(top, first).astype(np.float32))[owner])
            back *= pooled > 0
            chunk, which = np.nonzero(back)
            value = back[chunk, which]
            bytes_at = rows[chunk[:, None], at[chunk, which][:, None] * STRIDE + np.arange(WIDTH)]
            inputs = model["embed"][bytes_at].reshape(len(chunk), WIDTH * EMBED)
            grads = {k: np.zeros_like(v) for k, v in model.items()}
            np.add.at(grads["filters"].T, which, inputs * value[:, None])
            np.add.at(grads["embed"], bytes_at.reshape(-1), (model["filters"].T[which] * value[:, None]).reshape(-1, EMBED))
            grads |= {"bias": back.sum(0), "mean": mean.T @ off, "max": most.T @ off, "level": np.array([off.sum()], np.float32)}
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for k, (m, v) in moments.items():
                m += 0.1 * (grads[k] - m)
                v += 0.01 * (grads[k] ** 2 - v)
                model[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return model


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    """Probability of label 1 for each whole text; chunks of several texts share a block, long texts span blocks."""
    held = [chunks_of(t) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(rows) for rows, _ in held])[:-1]]).astype(int)
    rows, places = np.concatenate([r for r, _ in held]), np.concatenate([p for _, p in held])
    pooled = np.concatenate([_pooled(rows[a : a + _BLOCK], places[a : a + _BLOCK], model)[0] for a in range(0, len(rows), _BLOCK)])
    return _combined(pooled, first, model)[0]


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found: list[float] = []
            for at in range(0, len(texts), 64):
                part = texts[at : at + 64]
                found += [0.5] * len(part) if model is None else scores(part, model).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def learned(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The network from documents (doc_id, text) and the labels (doc_id, label) that may be learned from."""
    labels = labels.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    labelled = labels.count()
    if not labelled:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = docs.join(labels.filter(draw < SAMPLE / labelled), "doc_id").select("doc_id", "text", "label").toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    return fitted(sample["text"].tolist(), sample["label"].to_numpy(np.float32)) if len(sample) else None


def scored(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """``doc_id, held_out, score``; ``held_out`` is a condition on doc_id, whose documents are not learned from."""
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text")).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    given = labels.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("label"))
    model = learned(rows.filter("NOT held_out").select("doc_id", "text"), given)
    return rows.select("doc_id", "held_out", "text").mapInArrow(_scored(model), "doc_id long, held_out boolean, score double")
