"""Substring deduplication: compressed FM-indexes, one per shard, and matching statistics by backward search.

A window is 50 consecutive words. A word goes if a window covers it that also starts in a document with a smaller id.

Every window names an anchor: the 20-word run in it with the smallest hash. Equal windows have equal anchors, so windows
whose anchor only one document holds have no partner and are left out. The others become pieces (the neighbouring
windows of one anchor, with their words as text, which compresses where word hashes do not) that are dealt to shards by
their anchor; all occurrences of a window meet in one shard. Each shard numbers its words, indexes its different pieces
and streams them past the index by backward search, which reports for every window the smallest document that holds it.
Shards have a bounded number of words, whatever the input.

Anchors in more than ``HOT`` documents would bring a shard a piece from each: their windows are dealt one by one by
their own hash and met as one row per different window, however many documents hold it.

Nulls and odd input: a null text has no words; a row with a null doc_id loses nothing and takes nothing from others;
repeated rows of one id do not count against each other and get the same result; other columns are not looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written
from .fm_index import FMIndex
from .shingles import WordHashes, chained, words_in

WINDOW, ANCHOR = 50, 20
HOT = 2000
SHARD_WORDS = 200_000
#: Window digests that a task remembers, to send the words of a frequent window once.
SEEN = 100_000


class WordNumbers(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def row_key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2")]


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window start, the place of its anchor; and the hashes of all runs of anchor length."""
    runs = chained(hashes, ANCHOR)
    span = WINDOW - ANCHOR + 1
    starts = np.arange(len(hashes) - WINDOW + 1)
    return starts + np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1), runs


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = WordHashes()
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            words = words_in(text, lower=False)
            if len(words) < WINDOW:
                found.append(None)
                continue
            places, runs = anchors(held.of(words))
            found.append(np.unique(runs[np.unique(places)]).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "k1", "k2")] + [pa.array(found, pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "anchors"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of documents around shared anchors: by anchor, or window by window where the anchor is hot."""
    held, seen = WordHashes(), set()
    names = ("doc_id", "k1", "k2")
    for batch in batches:
        rows: dict[str, list] = {c: [] for c in (*names, "start", "windows", "key", "hot", "digest", "words")}

        def add(own: tuple, start: int, windows: int, key: int, words: bytes, once: bool, rows=rows) -> None:
            digest = hashlib.blake2b(words, digest_size=16).digest()
            if once and digest in seen:
                words = None
            elif once:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
            for c, v in zip(rows, (*own, start, windows, key, once, digest, words), strict=True):
                rows[c].append(v)

        columns = [batch.column(c).to_pylist() for c in (*names, "text", "shared", "hot")]
        for *own, text, shared, hot in zip(*columns, strict=True):
            words = words_in(text, lower=False)
            if len(words) < WINDOW:
                continue
            hashes = held.of(words)
            places, runs = anchors(hashes)
            turns = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
            ends = np.append(turns[1:], len(places))
            key = runs[places[turns]].view(np.int64)
            common, busy = np.isin(key, np.array(shared, np.int64)), np.isin(key, np.array(hot, np.int64))
            whole = chained(hashes, WINDOW).view(np.int64) if busy.any() else None
            for at in np.flatnonzero(common):
                start, end = int(turns[at]), int(ends[at])
                if busy[at]:
                    for s in range(start, end):
                        add(own, s, 1, int(whole[s]), b" ".join(words[s : s + WINDOW]), True)
                else:
                    add(own, start, end - start, int(key[at]), b" ".join(words[start : end + WINDOW - 1]), False)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(rows.values(), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)],
            list(rows),
        )


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; each shard is indexed and searched when it is complete."""
    shard, digests, pieces, owners, numbers = None, [], [], [], WordNumbers()

    def search() -> pa.RecordBatch:
        index = FMIndex(pieces, np.array(owners, np.int64), WINDOW)
        least = index.least_owner(np.arange(len(pieces)))
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(least, pa.list_(pa.int64()))], ["digest", "least"])

    for batch in batches:
        for own, digest, words, owner in zip(*(batch.column(c).to_pylist() for c in ("shard", "digest", "words", "owner")), strict=True):
            if own != shard and pieces:
                yield search()
                digests, pieces, owners, numbers = [], [], [], WordNumbers()
            shard = own
            digests.append(digest)
            pieces.append(numbers.of(words.split()))
            owners.append(owner)
    if pieces:
        yield search()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, texts = [], [], []
        for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
            words = words_in(text, lower=False)
            keep = words
            if starts:
                steps = np.zeros(len(words) + 1, np.int32)
                np.add.at(steps, np.unique(starts), 1)
                np.add.at(steps, np.unique(starts) + WINDOW, -1)
                keep = [words[i] for i in np.flatnonzero(np.cumsum(steps)[:-1] == 0)]
            counts.append(len(words))
            removed.append(len(words) - len(keep))
            texts.append(b" ".join(keep).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for every row; the kept words are joined by one space."""
    tables = Written(docs.sparkSession, "substrings", tidy=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.select("doc_id", "text", *row_key())
    anchored = keyed.filter("doc_id IS NOT NULL").mapInArrow(_anchored, "doc_id long, k1 long, k2 int, anchors array<long>")
    anchored = tables.keep(anchored.filter("anchors IS NOT NULL"), "anchors")
    each = anchored.select("doc_id", "k1", "k2", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    shared = tables.keep(shared.filter("low < high").select("anchor", (F.col("n") > HOT).alias("hot")), "shared")
    held = each.join(shared, "anchor").groupBy("k1", "k2").agg(F.collect_set("anchor").alias("shared"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    held = keyed.filter("doc_id IS NOT NULL").join(held, ["k1", "k2"])
    pieces = tables.keep(held.mapInArrow(_cut, "doc_id long, k1 long, k2 int, start int, windows int, key long, hot boolean, digest binary, words binary"), "pieces")
    tables.drop("anchors", "shared")

    words = pieces.filter("words IS NOT NULL").agg(F.coalesce(F.sum(F.col("windows") + WINDOW), F.lit(0))).first()[0]
    shards = max(1, round(words / SHARD_WORDS))
    different = pieces.groupBy("key", "digest", "windows", "hot").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.max("words").alias("words"))
    # a hot window meets only itself; any other piece may hold, or be, a window of a longer piece of its anchor
    dealt = different.filter("NOT hot OR owner < last").select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "digest", "words", "owner")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")
    least = tables.keep(dealt.mapInArrow(_searched, "digest binary, least array<long>"), "least")
    found = pieces.select("k1", "k2", "doc_id", "start", "digest").join(least, "digest")
    starts = F.transform("least", lambda low, i: F.when(low < F.col("doc_id"), F.col("start") + i))
    found = found.select("k1", "k2", F.array_compact(starts).alias("starts")).filter(F.size("starts") > 0)
    found = tables.keep(found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("starts")).alias("starts")), "found")
    tables.drop("pieces", "least")
    return keyed.join(found, ["k1", "k2"], "left").select("doc_id", "text", "starts").mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_text string")
