"""Phrase collocations, mined by partitioning (SON) and scored by exact counts.

Texts are lower-cased (A-Z) and split at punctuation and line ends into pieces, and those at spaces and tabs into words.
Documents are dealt to a few shards by a hash of their text. Each shard, which many tasks share, is mined completely for
phrases of one to three words at its share of the support, rounded up: a phrase that misses that in every shard misses the
global support, however unequal the shards are. Within a shard mining goes by levels, as a phrase of three words is no more
frequent than both of its pairs. The phrases that are frequent in some shard are united, and all their occurrences in all
documents are counted exactly.

Tasks count in chunks of words and send one row for each different phrase of a chunk. Mining knows phrases by 64-bit hashes,
as it only has to miss none; the exact counts are of the phrases themselves. Which phrases are worth sending is told by a
bitmap of hashes of fixed size. It never stops a phrase that matters; the others it lets through are frequent nowhere, so
their counts fall below the support. With more phrases than it can tell apart it stops fewer, and the result is the same.

Nulls and odd input: a null text is empty and has no words; a null language is ``und``; repeated rows count each;
doc_id and other columns are not looked at; very long texts are counted in slices that overlap by two words; ties in the score go
by the count and then the phrase, in the order of its bytes; a language without phrases has no rows; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written

MIN_COUNT, TOP, SHARDS = 10, 2000, 4
#: A pair inside a longer phrase goes when the longer one has at least this share (in hundredths) of its occurrences.
INSIDE = 50
#: Bytes of text that a task counts at a time.
CHUNK = 6_000_000
#: Rows that a task sends at a time.
SENT = 1 << 16
#: Different words of a chunk up to which the numbers of three fit into 63 bits.
MOST_WORDS = 1 << 21
#: log2 of the bits of a bitmap: 16 MB, whatever the input.
BITMAP_BITS = 27
#: Ranks of a language are taken within so many parts first.
PARTS = 64
_ENDS = bytes(range(0x0A, 0x0E)) + b".,;:!?"
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_ENDS))
_KEYS, _PHRASES = "shard int, key long, f long", "lang string, size int, phrase binary, f long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keys(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """64-bit names of a language's phrases, given the hashes of their first, second and third words."""
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), len(words)))
    x = np.full(len(words[0]), seed, np.uint64)
    for hashes in words:
        x = _mix(x ^ hashes)
    return x


def _bits(keys: np.ndarray, shard: np.ndarray | int) -> np.ndarray:
    """Bit numbers of phrases of a shard, or of all shards together (-1)."""
    return _mix(keys + np.asarray(shard + 2).astype(np.uint64)) >> np.uint64(64 - BITMAP_BITS)


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


class _Chunk:
    """The words of some texts of one language and shard: numbers into a list of different words."""

    def __init__(self, text: bytes, skip: int):
        """``skip`` leading words only give context: what ends in them was counted before."""
        found = pc.split_pattern(pa.array([text], pa.large_binary()), b" ").flatten().dictionary_encode()
        self.words = found.dictionary.cast(pa.binary())
        at = found.indices.to_numpy()
        blank, end = (int(pc.index(self.words, pa.scalar(x, pa.binary())).as_py()) for x in (b"", b"\n"))
        self.at = at[at != blank].astype(np.int64)
        self.word = self.at != end
        self.word[: min(skip, len(self.word))] &= False
        pair = self.at != end
        self.inside = pair[:-1] & self.word[1:]
        self.inside_three = pair[:-2] & pair[1:-1] & self.word[2:]

    def counted(self, size: int, wanted: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """Phrases of ``size`` words (those that start where ``wanted`` is true), by the numbers of their words, and counts."""
        last = len(self.at) - size + 1
        if last <= 0:
            return [np.empty(0, np.int64)] * size, np.empty(0, np.int64)
        ok = (self.word, self.inside, self.inside_three)[size - 1]
        starts = np.flatnonzero(ok if wanted is None else ok & wanted)
        code, base = self.at[starts], len(self.words)
        for k in range(1, size):
            following = self.at[starts + k]
            if k == 2 and base >= MOST_WORDS:
                pairs, code = np.unique(code, return_inverse=True)
                codes, counts = np.unique(code * base + following, return_counts=True)
                firsts = pairs[codes // base]
                return [firsts // base, firsts % base, codes % base], counts
            code = code * base + following
        codes, counts = np.unique(code, return_counts=True)
        return [codes // base**k % base for k in range(size - 1, -1, -1)], counts

    def spelled(self, numbers: list[np.ndarray]) -> pa.Array:
        parts = [self.words.take(pa.array(n)) for n in numbers]
        return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))

    def listed(self, size: int, lang: str, shard: int, bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """For each start: is the bit of the phrase that starts there set?"""
        last = max(0, len(self.at) - size + 1)
        places = _bits(_keys(lang, [hashes[self.at[k : k + last]] for k in range(size)]), shard)
        return (bits[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _slices(text: bytes, limit: int) -> Iterator[tuple[bytes, int]]:
    """Slices of a spaced text with the number of words that each repeats of the one before."""
    begin, kept = 0, []
    while begin < len(text):
        end = text.find(b" ", begin + limit)
        part = text[begin:] if end < 0 else text[begin:end]
        yield b" ".join([b"", b"\n", *kept, part, b"\n"]), len(kept) + 1
        kept = [*kept, *filter(None, part.split(b" "))][-2:]
        begin = len(text) if end < 0 else end


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, str, _Chunk]]:
    """Texts gathered by shard and language; the largest group is counted when a task holds ``limit`` bytes."""
    held: dict[tuple[int, str], list[bytes]] = {}
    total, sizes = 0, {}
    for batch in batches:
        for shard, lang, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "lang", "text")), strict=True):
            spaced = text.translate(_LETTERS).replace(b"\n", b" \n ")
            if len(spaced) > limit:
                for part, skip in _slices(spaced, limit):
                    yield shard, lang, _Chunk(part, skip)
                continue
            held.setdefault((shard, lang), []).append(spaced)
            sizes[shard, lang] = sizes.get((shard, lang), 0) + len(spaced)
            total += len(spaced)
            while total > limit:
                largest = max(sizes, key=sizes.get)
                total -= sizes.pop(largest)
                yield *largest, _Chunk(b" ".join([b"", *(b" \n " + t for t in held.pop(largest)), b"\n"]), 0)
    for group, texts in held.items():
        yield *group, _Chunk(b" ".join([b"", *(b" \n " + t for t in texts), b"\n"]), 0)


def _keys_sent(shard: int, lang: str, hashes: np.ndarray, numbers: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = _keys(lang, [hashes[n] for n in numbers]).view(np.int64)
    for at in range(0, len(counts), SENT):
        own = counts[at : at + SENT]
        columns = [pa.array(np.full(len(own), shard, np.int32)), pa.array(keys[at : at + SENT]), pa.array(own)]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "key", "f"])


def _words_and_pairs(limit: int):
    """Words and pairs of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, lang, chunk in _chunks(batches, limit):
            hashes = _hashes(chunk.words)
            for size in (1, 2):
                yield from _keys_sent(shard, lang, hashes, *chunk.counted(size))

    return run


def _threes(limit: int, bitmap: Broadcast):
    """Phrases of three words both of whose pairs are frequent in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for shard, lang, chunk in _chunks(batches, limit):
            hashes = _hashes(chunk.words)
            pair = chunk.listed(2, lang, shard, bits, hashes)
            yield from _keys_sent(shard, lang, hashes, *chunk.counted(3, pair[:-1] & pair[1:]))

    return run


def _candidates(limit: int, bitmap: Broadcast):
    """Counts of all candidates, whatever the shard, and of all words (size 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for _, lang, chunk in _chunks(batches, limit):
            hashes = _hashes(chunk.words)
            sums = [(0, pa.array([b""], pa.binary()), np.array([chunk.word.sum()], np.int64))]
            for size in (1, 2, 3):
                numbers, counts = chunk.counted(size, chunk.listed(size, lang, -1, bits, hashes))
                for at in range(0, len(counts), SENT):
                    sums.append((size, chunk.spelled([n[at : at + SENT] for n in numbers]), counts[at : at + SENT]))
                for of, phrases, own in sums:
                    columns = [pa.repeat(pa.scalar(lang, pa.string()), len(own)), pa.array(np.full(len(own), of, np.int32)), phrases, pa.array(own)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "f"])
                sums = []

    return run


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key").to_numpy().view(np.uint64)
        bits = _bits(keys, batch.column("shard").to_numpy().astype(np.int64)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(bits + 1)], ["bit"])


def _bitmap(phrases: DataFrame) -> Broadcast:
    """The bitmap of ``phrases`` (shard, key): as many bytes for any number of them."""
    bits = phrases.select("shard", "key").mapInArrow(_bits_of, "bit long")
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    whole = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for part, own in parts.collect():  # parts of 4096 bytes, numbered from 1
        whole[4096 * (part - 1) : 4096 * part] = np.frombuffer(own, np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(whole.tobytes())


def counted_phrases(docs: DataFrame, tables: Written, min_count: int = MIN_COUNT, shards: int = SHARDS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``lang, size, phrase, f`` of all phrases of up to three words found ``min_count`` times, and ``lang, n``."""
    text = F.coalesce(F.col("`text`").cast("string"), F.lit("")).cast("binary")
    texts = docs.select(text.alias("text"), F.coalesce(F.col("`lang`").cast("string"), F.lit("und")).alias("lang"))
    texts = texts.select(F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"), "lang", "text")
    support = -(-min_count // shards)

    count = F.sum("f").alias("f")

    local = texts.mapInArrow(_words_and_pairs(chunk), _KEYS).groupBy("key", "shard").agg(count).filter(F.col("f") >= support)
    local = tables.keep(local.select("shard", "key"), "local")
    threes = texts.mapInArrow(_threes(chunk, _bitmap(local)), _KEYS).groupBy("key", "shard").agg(count).filter(F.col("f") >= support)
    threes = tables.keep(threes.select("shard", "key"), "threes")
    listed = _bitmap(local.unionByName(threes).withColumn("shard", F.lit(-1)))
    whole = texts.withColumn("shard", F.lit(-1))
    counts = whole.mapInArrow(_candidates(chunk, listed), _PHRASES).groupBy("lang", "size", "phrase").agg(count)
    counts = counts.filter((F.col("f") >= min_count) | (F.col("size") == 0)).withColumn("phrase", F.col("phrase").cast("string"))
    counts = tables.keep(counts, "counts")
    return counts.filter("size > 0"), counts.filter("size = 0").select("lang", F.col("f").alias("n"))


def _exact(x: str) -> Column:
    return F.col(x).cast("decimal(38,0)")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the phrases of two or three words in ``counts`` that no longer one stands for."""
    word = F.split("phrase", " ")
    join = lambda *at: F.concat_ws(" ", *[F.get(word, F.lit(n)) for n in at])
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), join(*left).alias("left"), join(*right).alias("right"))
    two, three = F.array(cut(1, [0], [1])), F.array(cut(1, [0], [1, 2]), cut(2, [0, 1], [2]))
    longer = counts.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    cuts = longer.select("lang", "phrase", "size", "a", F.explode(F.when(F.col("size") == 2, two).otherwise(three)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "size", "a", "cut.k", "cut.left", "cut.right")
    for side, f in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)), ["lang", side])
    above, below = F.lit(1000000).cast("decimal(38,0)") * _exact("a") * _exact("a"), _exact("l") * _exact("r")
    cuts = cuts.withColumn("above", above).withColumn("below", below).withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = longer.filter("size = 3").select("lang", "a", F.explode(F.array(join(0, 1), join(1, 2))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    best = best.join(inner, ["lang", "phrase"], "left").filter((F.col("size") == 3) | F.coalesce(100 * F.col("most") < INSIDE * F.col("a"), F.lit(True)))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, shards: int = SHARDS, chunk: int = CHUNK) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language."""
    counts, totals = counted_phrases(docs, Written(docs.sparkSession, "collocations"), min_count, shards, chunk)
    order = (F.desc("score"), F.desc("a"), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    rows = scored(counts).withColumn("part", part)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
