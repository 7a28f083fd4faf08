"""Packing documents into fixed-length sequences along a space-filling curve.

A document becomes its token ids and one end id. Its hashed vector (token counts in a fixed number of hash buckets) is
projected to few dimensions; the place of that point on a Hilbert curve is its sort key. Documents are ranged by the key,
so neighbours in a sequence are alike, and laid end to end: sequence n holds the ids from n * length on. So only the very
last sequence can be short, whatever the document lengths are.

Ids are those of the ``tokenizers`` file. Texts are cut before spaces, and the ids of each cut are remembered; cuts not met
before are encoded from the same vocabulary by ``tiktoken``, which needs less time a call. A cut is exact only where no
white space of any kind stands before the space, as a run of white space may be one token: texts in which a cut ends
with white space are encoded whole; texts that spell a special token go to ``tokenizers`` itself.

Nulls and odd input: a null or empty text is its end id alone; a null doc_id stays null; repeated rows are packed each on
its own; other columns are not looked at; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

LENGTH = 1024
END_ID = 0
BUCKETS, DIMENSIONS, BITS = 256, 3, 10
#: Cuts whose ids a task remembers.
HELD = 300_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids as little-endian bytes, two per id for vocabularies of up to 65 536 and four beyond."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.kind = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        ranks = {bytes(letter[c] for c in token): number for token, number in vocabulary.items() if token not in self.special}
        self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.held: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)
        cuts = text.replace(" ", "\0 ").split("\0")
        if "\0" in text:
            return self._bytes(self.quick.encode_ordinary(text))
        held = self.held
        if len(held) > HELD:
            held.clear()
        for cut in cuts:
            if cut not in held:
                if cut[-1:].isspace():
                    return self._bytes(self.quick.encode_ordinary(text))
                held[cut] = self._bytes(self.quick.encode_ordinary(cut))
        return b"".join(map(held.__getitem__, cuts))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows), each coordinate of ``bits`` bits."""
    x = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo, from the largest cubes down, the turns and mirrors of the cube a point lies in
        low = q - 1
        for d in range(len(x)):
            inside = (x[d] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap if d else x[0]
        q >>= 1
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = (key << 1) | (((x[d] ^ turn) >> bit) & 1)
    return key


def _projected(counts: np.ndarray) -> np.ndarray:
    """Points of documents (rows of bucket counts) in few dimensions, as integers."""
    directions = np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS))
    scaled = counts / np.maximum(1e-9, np.linalg.norm(counts, axis=1))[:, None]
    spread = np.tanh(2 * (scaled @ directions))
    return np.clip(((spread + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end = encoder._bytes([END_ID])
        for batch in batches:
            ids, lengths, counts = [], [], []
            for text in batch.column("text").to_pylist():
                own = encoder.encode(text) + end if text else end
                numbers = np.frombuffer(own, encoder.kind)
                ids.append(own)
                lengths.append(len(numbers))
                counts.append(np.bincount((numbers.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(24), minlength=BUCKETS))
            keys = hilbert(_projected(np.array(counts, float).reshape(len(ids), BUCKETS)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "key", "n", "ids"])

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        before = total + np.cumsum(n) - n
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(n), part, np.int32)), pa.array(before, pa.int64()), batch.column("n")], ["row", "part", "before", "n"])


def _pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        for batch in batches:
            owners, rows = [], []
            for doc, n, raw, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "at")), strict=True):
                ids = np.frombuffer(raw, np.dtype("<u2") if len(raw) == 2 * n else np.dtype("<u4")).astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    owners.append(doc)
                    rows.append((start, size, zlib.crc32(ids[start : start + size].tobytes()), n, sequence, offset))
                    start += size
            values = np.array(rows, np.int64).reshape(len(rows), len(names))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64())] + [pa.array(values[:, k]) for k in range(len(names))], ["doc_id", *names])

    return run


def packed(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    tables = Written(spark, "packing")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = texts.mapInArrow(_tokens(tokenizer or default_tokenizer()), "doc_id long, key long, n long, ids binary")
    tokens = tables.keep(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    ranged = tokens.select("row", "doc_id", "key", "n").repartitionByRange("key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    placed = tables.keep(ranged.mapInArrow(_running, "row long, part int, before long, n long"), "placed")
    # as many totals as there are partitions, whatever the number of rows
    totals, offset, offsets = placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect(), 0, []
    for part, n in totals:
        offsets.append((part, offset))
        offset += n
    first = spark.createDataFrame(offsets, "part int, first long")
    places = placed.join(F.broadcast(first), "part").select("row", (F.col("first") + F.col("before")).alias("at"))
    return tokens.join(places, "row").select("doc_id", "n", "ids", "at").mapInArrow(
        _pieces(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
