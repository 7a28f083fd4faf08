"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of it is a binary question that a linear classifier over hashed byte n-grams of the
whole text answers. A text gets the language whose codeword costs least: the logistic losses of its bits, weighted by how
reliable each bit was in training. A small gap to the next language is flagged as ambiguous.

The classifiers are fitted on a bounded sample, ``PER_LANGUAGE`` documents of each language (expected number, chosen by a
hash of the id); they are then applied to every document. There may be up to ``MOST_LANGUAGES`` languages.

Nulls and odd input: rows with a null label or id are not learned from; a null text, or one without a letter, is ``und``
with score 0; without any labels every text is ``und``; repeated rows get equal results; other columns are not looked at;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
GRAMS, SIZE = (1, 2, 3), 4096
PER_LANGUAGE, MOST_LANGUAGES = 600, 256
AMBIGUOUS = 0.2
_BLOCK = 128


def has_letter(text: str | None) -> bool:
    return bool(text) and next((True for c in text if c.isalpha()), False)


def grams(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams, so that the vector has length 1."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    counts = np.zeros(SIZE)
    run = np.zeros_like(raw)
    for n in range(1, max(GRAMS) + 1):
        run = (run[: len(raw) - n + 1] * np.uint32(257) + raw[n - 1 :] + np.uint32(1)) if n > 1 else raw + np.uint32(1)
        if n in GRAMS and len(run):
            counts += np.bincount((run * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=SIZE)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language: all splits in two for up to five, else the best of many random codes."""
    if languages <= 5:
        bits = [[1 if (split >> k) & 1 else -1 for k in range(languages)] for split in range(1, 1 << max(languages - 1, 1))]
        return np.array(bits, np.float32).T
    length = 8 * int(np.ceil(np.log2(languages)))
    best, apart = None, -1
    for seed in range(100):
        code = np.where(np.random.default_rng(seed).random((languages, length)) < 0.5, -1, 1).astype(np.float32)
        distance = (length - code @ code.T) / 2 + length * np.eye(languages)
        if distance.min() > apart and np.abs(code.sum(0)).max() < languages:
            best, apart = code, distance.min()
    return best


def fitted(x: np.ndarray, labels: np.ndarray, languages: int, epochs: int = 12) -> dict[str, np.ndarray]:
    """Logistic classifiers for all bits at once, languages weighted equally; Adam over shuffled parts."""
    code = codewords(languages)
    target = code[labels]
    weight = (1.0 / np.bincount(labels, minlength=languages)[labels]).astype(np.float32)
    weight *= len(labels) / weight.sum()
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, b)]
    order, step = np.random.default_rng(3), 0
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(x)), max(1, len(x) // 128)):
            step += 1
            z = 8 * (x[part] @ w + b)
            g = -8 * target[part] / (1 + np.exp(np.clip(target[part] * z, -30, 30))) * weight[part, None] / len(part)
            for p, grad, (m, v) in zip((w, b), (x[part].T @ g + 1e-5 * w, g.sum(0)), moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    right = ((x @ w + b) * target > 0).mean(0)
    return {"w": w, "b": b, "code": code, "trust": np.maximum(1e-3, 2 * right - 1).astype(np.float32)}


def decoded(x: np.ndarray, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, its share of all languages' exp(-cost), and the gap to the next one's share."""
    z = 8 * (x @ model["w"] + model["b"])
    cost = np.stack([(np.logaddexp(0, -z * code) * model["trust"]).sum(1) for code in model["code"]], axis=1)
    share = np.exp(cost.min(1, keepdims=True) - cost)
    share /= share.sum(1, keepdims=True)
    ordered = np.sort(share, axis=1)
    gap = ordered[:, -1] - (ordered[:, -2] if share.shape[1] > 1 else 0)
    return share.argmax(1), ordered[:, -1], gap


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [grams(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), batch.column("label"), pa.array(found, pa.binary())], ["doc_id", "mark", "label", "grams"])


def _predicted(names: list[str], model: dict[str, np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            name, score, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
            known = [k for k, t in enumerate(texts) if model is not None and has_letter(t)]
            for at in range(0, len(known), _BLOCK):
                part = known[at : at + _BLOCK]
                for k, n, s, gap in zip(part, *decoded(np.stack([grams(texts[k]) for k in part]), model), strict=True):
                    name[k], score[k], unsure[k] = names[n], float(s), bool(gap < AMBIGUOUS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(name), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def learned(rows: DataFrame) -> tuple[list[str], dict[str, np.ndarray] | None]:
    """Languages and the model from rows (doc_id, text, label) that may be learned from."""
    rows = rows.filter("label IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return [], None
    names = [r["label"] for r in counts]
    share = F.coalesce(*[F.when(F.col("label") == r["label"], F.lit(PER_LANGUAGE / r["n"])) for r in counts])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = rows.filter(draw < share).select("doc_id", F.xxhash64("text").alias("mark"), "label", "text")
    sample = sample.mapInArrow(_featured, "doc_id long, mark long, label string, grams binary").toPandas()
    # learned in one order, however the table is dealt to partitions
    sample = sample.sort_values(["doc_id", "mark", "label"], kind="stable")
    if sample.empty:
        return [], None
    x = np.stack([np.frombuffer(g, np.float16) for g in sample["grams"]]).astype(np.float32)
    return names, fitted(x, np.array([names.index(v) for v in sample["label"]]), len(names))


def identified(docs: DataFrame, held_out, label: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous``; rows where the column ``held_out`` is true are not learned from."""
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(f"`{label}`").cast("string").alias("label"))
    names, model = learned(rows.filter("NOT held_out"))
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predicted(names, model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
