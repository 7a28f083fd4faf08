"""Alignment of two tokenizers' tokens by associative fragments of byte ranges.

Tokens of A and of B that cover the same bytes are cut into groups where both have an end. A byte range alone does not
know where the groups that reach over its borders begin or end. So it yields a fragment: what stands before its first
common end (the open prefix), the groups after that (closed), and what stands after its last common end (the open suffix).
Fragments compose: the left one's suffix and the right one's prefix make one more closed group, or stay open where a side
has no common end. Composing is associative, so the fragments of a very long document are made by different tasks and
joined by a tree of shuffles; only open ends move up that tree, closed groups stay where they were made.

A link is a pair of tokens, one of A and one of B, whose bytes overlap. How many links the corpus has for a pair of ids is
counted over all documents. Tasks gather links in chunks of documents; a chunk asks for the count of each of its pairs of
ids once, and the answers come back to the chunk.

Ranges end at single spaces between other characters, where both tokenizers always stop: A's pattern lets a space only
begin a word, and no piece of B has a space behind another character. Words between such spaces are encoded and aligned
once for as long as a task remembers them.

Nulls and odd input: texts that are null or empty, or that one of the tokenizers does not give back byte for byte, have no
tokens: zeros and an empty digest; a null doc_id stays null; repeated rows each get their row and count each; ids that
count equally are all best; texts that spell special tokens are plain; very long texts are cut as said, a text without
single spaces is one range; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

#: Characters of a byte range, fragments that one step of the tree composes, and links of a chunk.
RANGE, FAN, LINKS = 1 << 18, 16, 1 << 21
#: Words that a task remembers, and their characters in all; characters of texts whose new words are encoded together.
HELD, HELD_CHARACTERS, TOGETHER = 300_000, 5_000_000, 500_000
#: Words encoded in one call, rows that are Python strings at a time, and links of a chunk that wait to be counted.
ENCODED, SLICE, FOLDED = 4096, 256, 1 << 18
_JOINT = re.compile(r"(?<=\S) (?=\S)")
_LOOSE = re.compile(r"\s\s|^\s|\s$")
_DONE = "n_a long, n_b long, n_groups long, n_links long"
_NONE = np.empty(0, np.int64)
_ROW = ["row", "links", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


@dataclass(frozen=True)
class Run:
    """Neighbouring tokens of both tokenizers: ids and sizes in bytes."""

    a: np.ndarray = field(default_factory=lambda: _NONE)
    a_size: np.ndarray = field(default_factory=lambda: _NONE)
    b: np.ndarray = field(default_factory=lambda: _NONE)
    b_size: np.ndarray = field(default_factory=lambda: _NONE)

    def __add__(self, other: Run) -> Run:
        return Run(*(np.concatenate([x, y]) for x, y in zip(self.columns(), other.columns(), strict=True)))

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_size, self.b, self.b_size

    def part(self, a: slice, b: slice) -> Run:
        return Run(self.a[a], self.a_size[a], self.b[b], self.b_size[b])

    def packed(self) -> bytes:
        return struct.pack("<QQ", len(self.a), len(self.b)) + b"".join(x.astype("<i8").tobytes() for x in self.columns())

    @classmethod
    def unpacked(cls, raw: bytes) -> Run:
        n, m = struct.unpack_from("<QQ", raw)
        values = np.frombuffer(raw, "<i8", offset=16)
        return cls(*np.split(values, [n, 2 * n, 2 * n + m]))

    def text(self) -> bytes:
        return b",".join(b"%d" % x for x in self.a) + b"|" + b",".join(b"%d" % x for x in self.b)

    def links(self) -> np.ndarray:
        """Pairs of ids, one number each, of the tokens whose bytes overlap; both sides start at the same byte."""
        ends_a, ends_b = np.cumsum(self.a_size), np.cumsum(self.b_size)
        first = np.searchsorted(ends_b, ends_a - self.a_size, side="right")
        last = np.searchsorted(ends_b, ends_a, side="left")
        counts = np.minimum(last, len(ends_b) - 1) - first + 1
        at = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return (np.repeat(self.a, counts) << np.int64(32)) | self.b[at]


@dataclass(frozen=True)
class Fragment:
    """A byte range's alignment; without a common end (``ends`` false) all of it is ``prefix``."""

    prefix: Run = Run()
    closed: tuple[Run, ...] = ()
    suffix: Run = Run()
    ends: bool = False

    @classmethod
    def of(cls, run: Run, begin_a: int = 0, begin_b: int = 0) -> Fragment:
        """The fragment of a range whose tokens of A and B begin at these bytes, counted from anywhere."""
        ends_a, ends_b = begin_a + np.cumsum(run.a_size), begin_b + np.cumsum(run.b_size)
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        if not len(at_a):
            return cls(run)
        cuts_a, cuts_b = [0, *(at_a + 1), len(run.a)], [0, *(at_b + 1), len(run.b)]
        parts = [run.part(slice(*cuts_a[k : k + 2]), slice(*cuts_b[k : k + 2])) for k in range(len(cuts_a) - 1)]
        return cls(parts[0], tuple(parts[1:-1]), parts[-1], True)

    def __add__(self, other: Fragment) -> Fragment:
        if not other.ends:
            if not self.ends:
                return Fragment(self.prefix + other.prefix)
            return Fragment(self.prefix, self.closed, self.suffix + other.prefix, True)
        if not self.ends:
            return Fragment(self.prefix + other.prefix, other.closed, other.suffix, True)
        return Fragment(self.prefix, (*self.closed, self.suffix + other.prefix, *other.closed), other.suffix, True)


def _spelled_links(a: list[int], a_size: list[int], b: list[int], b_size: list[int]) -> tuple[bytes, bytes, int]:
    """Text of the groups, links and number of groups of tokens that begin and end at the same bytes."""
    links, groups, i, j = array("q"), [], 0, 0
    end_a, end_b, begin_a, begin_b = a_size[0], b_size[0], 0, 0
    while True:
        links.append(a[i] << 32 | b[j])
        if end_a == end_b:
            if i == begin_a and j == begin_b:
                groups.append(f"{a[i]}|{b[j]}")
            else:
                groups.append(",".join(map(str, a[begin_a : i + 1])) + "|" + ",".join(map(str, b[begin_b : j + 1])))
            i, j = i + 1, j + 1
            if i == len(a):
                return ";".join(groups).encode(), links.tobytes(), len(groups)
            begin_a, begin_b, end_a, end_b = i, j, end_a + a_size[i], end_b + b_size[j]
        elif end_a < end_b:
            i += 1
            end_a += a_size[i]
        else:
            j += 1
            end_b += b_size[j]


class Aligner:
    """Both tokenizers, and the words they have aligned."""

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        # the vocabulary is that of the file; tiktoken merges it in the same way and makes no objects beside the ids
        with open(path_a, encoding="utf-8") as stored:
            vocabulary = json.load(stored)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in set(shown)]
        letter = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(hidden)}
        ranks = {bytes(map(letter.__getitem__, token)): number for token, number in vocabulary.items() if set(token) <= letter.keys()}
        self.a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, number in ranks.items():
            self.a_bytes[number] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b_bytes = [self._piece(n) for n in range(self.b.get_piece_size())]
        self._forget()

    def _forget(self) -> None:
        #: numbers of the words held; by number: groups, links, and sums with a mark of words that are not given back
        self.numbers: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.links: list[bytes] = []
        self.sums = np.zeros((1 << 12, 5), np.int64)
        self.characters = 0

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode()

    def run(self, text: str) -> Run | None:
        """Tokens of space + text, None where one side's bytes differ from it."""
        a, b = self.a(" " + text), self.b.encode(text)
        sizes = self._sizes(text, a, b)
        return sizes and Run(*(np.array(x, np.int64) for x in (a, sizes[0], b, sizes[1])))

    def _sizes(self, text: str, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        a_bytes, b_bytes = list(map(self.a_bytes.__getitem__, a)), list(map(self.b_bytes.__getitem__, b))
        if b"".join(a_bytes) != (whole := (" " + text).encode()) or b"".join(b_bytes) != whole:
            return None
        return list(map(len, a_bytes)), list(map(len, b_bytes))

    def _learn(self, words: list[str]) -> None:
        """Encode and align words that are not held."""
        while len(self.sums) < len(self.texts) + len(words):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        for word, b in zip(words, self.b.encode(words, num_threads=1), strict=True):
            a = self.a(" " + word)
            number = self.numbers[word] = len(self.texts)
            text = links = b""
            if sizes := self._sizes(word, a, b):
                text, links, groups = _spelled_links(a, sizes[0], b, sizes[1])
                self.sums[number] = len(a), len(b), groups, len(links) // 8, 0
            else:
                self.sums[number] = 0, 0, 0, 0, 1
            self.texts.append(text)
            self.links.append(links)
            self.characters += len(word)

    def aligned(self, texts: list[str]) -> Iterator[list[int]]:
        """For each text the numbers of its words, cut at the single spaces between other characters.

        Numbers hold until the next one is asked for.
        """
        begin = 0
        while begin < len(texts):
            end, size = begin + 1, len(texts[begin])
            while end < len(texts) and (size := size + len(texts[end])) <= TOGETHER:
                end += 1
            parts = [_words(text) for text in texts[begin:end]]
            different = dict.fromkeys(w for own in parts for w in own)
            fresh = [w for w in different if w not in self.numbers]
            if len(self.numbers) + len(fresh) > HELD or self.characters > HELD_CHARACTERS:
                self._forget()
                fresh = list(different)
            for at in range(0, len(fresh), ENCODED):
                self._learn(fresh[at : at + ENCODED])
            for own in parts:
                yield list(map(self.numbers.__getitem__, own))
            begin = end

    def closed(self, words: list[int]) -> tuple[list[int] | None, bytes, bytes]:
        """Sums, text and links of neighbouring words; no sums where a word is not given back."""
        *sums, lost = self.sums[words].sum(axis=0).tolist() if words else [0] * 5
        if lost:
            return None, b"", b""
        return sums, b";".join(map(self.texts.__getitem__, words)), b"".join(map(self.links.__getitem__, words))


def _words(text: str) -> list[str]:
    return _JOINT.split(text) if _LOOSE.search(text) else text.split(" ")


def _zipped(links: bytes) -> bytes:
    return struct.pack("<Q", len(links)) + pa.compress(links, codec="zstd", asbytes=True)


def _unzipped(raw: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], struct.unpack_from("<Q", raw)[0], codec="zstd", asbytes=True), np.int64)


def ranges(text: str, size: int) -> list[str]:
    """A text cut at single spaces, which go, after ``size`` characters at least."""
    out, begin = [], 0
    while cut := _JOINT.search(text, begin + size):
        out.append(text[begin : cut.start()])
        begin = cut.end()
    return [*out, text[begin:]]


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                parts = ranges(text, size)
                columns = [[row] * len(parts), [doc] * len(parts), range(len(parts)), parts]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["row", "doc_id", "part", "text"])

    return run


def _whole_documents(paths: tuple[str, str], most: int):
    """Documents of one range, all of whose groups are closed, in chunks of links."""

    def aligned_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        aligner = Aligner(*paths)
        for batch in _sliced(batches):
            texts = batch.column("text").to_pylist()
            sums, digests, links, plain = [[0] * 4 for _ in texts], [""] * len(texts), [None] * len(texts), []
            filled = [n for n, text in enumerate(texts) if text]
            for n, words in zip(filled, aligner.aligned([texts[n] for n in filled]), strict=True):
                own, closed, raw = aligner.closed(words)
                if own:
                    sums[n], digests[n], links[n] = own, hashlib.sha256(closed).hexdigest(), _zipped(raw)
                    plain.append(np.frombuffer(raw, np.int64))
            columns = [pa.array(c, pa.int64()) for c in np.array(sums, np.int64).reshape(-1, 4).T]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(links, pa.binary()), batch.column("doc_id"), *columns, pa.array(digests, pa.string())], _ROW), plain

    return lambda batches: _gathered(aligned_rows(batches), most)


def _fragments(paths: tuple[str, str]):
    """Ranges of longer documents: closed groups are summed and spelled, open ends packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*paths)
        for batch in batches:
            out = []
            texts = batch.column("text").to_pylist()
            rows = zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "part")), strict=True)
            for row, text, words in zip(rows, texts, aligner.aligned(texts), strict=True):
                sums, closed, links = aligner.closed(words[1:])
                first = aligner.run(_words(text)[0])
                if not sums or not first:
                    out.append((*row, False, 0, 0, 0, 0, b"", None, b"", b""))
                    continue
                # the first end of the first word is the first common end of the range, and the last word closes it
                head = Fragment.of(first)
                for group in reversed(head.closed):
                    more = group.links()
                    sums = [x + y for x, y in zip(sums, (len(group.a), len(group.b), 1, len(more)), strict=True)]
                    closed, links = group.text() + b";" * bool(closed) + closed, more.tobytes() + links
                out.append((*row, True, *sums, closed, _zipped(links), head.prefix.packed(), head.suffix.packed()))
            names = ("row", "doc_id", "part", "fine", "n_a", "n_b", "n_groups", "n_links", "closed", "links", "prefix", "suffix")
            types = (pa.int64(),) * 3 + (pa.bool_(),) + (pa.int64(),) * 4 + (pa.binary(),) * 4
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))

    return run


_OPEN = "row long, part long, at long, ends boolean, prefix binary, suffix binary, seam binary"


def _composed(fan: int):
    """Sorted open ends: those of ``fan`` neighbours become one; the groups closed between them leave as seams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, at = None, Fragment(), 0

        def ended() -> tuple:
            return (group[0], group[1], at, last.ends, last.prefix.packed(), last.suffix.packed(), None)

        for batch in batches:
            out = []
            for row, part, begin, ends, prefix, suffix in zip(*(batch.column(c).to_pylist() for c in ("row", "part", "at", "ends", "prefix", "suffix")), strict=True):
                own = Fragment(Run.unpacked(prefix), (), Run.unpacked(suffix), ends)
                if group != (row, part // fan):
                    if group:
                        out.append(ended())
                    group, last, at = (row, part // fan), own, begin
                    continue
                last = last + own
                # a group closed here stands before the right fragment's closed groups
                out += [(row, None, begin, None, None, None, g.packed()) for g in last.closed]
                last = Fragment(last.prefix, (), last.suffix, last.ends)
            yield _open_batch(out)
        if group:
            yield _open_batch([ended()])

    return run


def _open_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("row", "part", "at", "ends", "prefix", "suffix", "seam")
    types = (pa.int64(),) * 3 + (pa.bool_(),) + (pa.binary(),) * 3
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups closed between ranges, spelled as their ranges are."""
    for batch in batches:
        runs = [Run.unpacked(raw) for raw in batch.column("seam").to_pylist()]
        links = [r.links() for r in runs]
        sums = [pa.array(x, pa.int64()) for x in ([len(r.a) for r in runs], [len(r.b) for r in runs], [1] * len(runs), [len(x) for x in links])]
        texts, raw = pa.array([r.text() for r in runs], pa.binary()), pa.array([_zipped(x.tobytes()) for x in links], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("at"), *sums, texts, raw], ["row", "part", "n_a", "n_b", "n_groups", "n_links", "closed", "links"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted groups of documents, hashed as they stream past."""
    row, digest, begun = None, hashlib.sha256(), False

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([digest.hexdigest()])], ["row", "groups_sha256"])

    for batch in batches:
        for own, closed in zip(batch.column("row").to_pylist(), batch.column("closed").to_pylist(), strict=True):
            if own != row:
                if row is not None:
                    yield ended()
                row, digest, begun = own, hashlib.sha256(), False
            if closed:
                digest.update(b";" + closed if begun else closed)
                begun = True
    if row is not None:
        yield ended()


def _long_documents(texts: DataFrame, tables: Written, paths: tuple[str, str], size: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Rows of documents of several ranges (as of those of one, without links), and their links by row."""
    cut = texts.mapInArrow(_cut(size), "row long, doc_id long, part long, text string").repartition("row", "part")
    schema = f"row long, doc_id long, part long, fine boolean, {_DONE}, closed binary, links binary, prefix binary, suffix binary"
    pieces = tables.keep(cut.mapInArrow(_fragments(paths), schema), "pieces")
    states = pieces.groupBy("row").agg(F.bool_and("fine").alias("fine"), F.max("part").alias("last"), F.first("doc_id").alias("doc_id"))
    states = tables.keep(states, "states")
    fine = pieces.join(states.filter("fine").select("row"), "row", "left_semi")

    ends = fine.select("row", "part", F.col("part").alias("at"), F.lit(True).alias("ends"), "prefix", "suffix", F.lit(None).cast("binary").alias("seam"))
    last = states.agg(F.max("last")).first()[0] or 0
    seams, turn = [], 0
    while last > 0:
        dealt = ends.repartition("row", F.floor(F.col("part") / fan)).sortWithinPartitions("row", "part")
        turn, last = turn + 1, last // fan
        made = tables.keep(dealt.mapInArrow(_composed(fan), _OPEN), f"ends-{turn}")
        seams.append(made.filter("seam IS NOT NULL").select("row", "at", "seam"))
        ends = made.filter("seam IS NULL")
    # a document begins at a common end, so what is open before its first one is a group; it ends at one
    seams.append(ends.select("row", F.lit(0).cast("long").alias("at"), F.col("prefix").alias("seam")))
    joints = seams[0]
    for more in seams[1:]:
        joints = joints.unionByName(more)
    groups = f"row long, part long, {_DONE}, closed binary, links binary"
    between = tables.keep(joints.mapInArrow(_seams, groups), "between")

    inside = fine.select(*between.columns, F.lit(1).alias("step")).unionByName(between.withColumn("step", F.lit(0)))
    sums = inside.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")])
    spelled = inside.select("row", "part", "step", "closed").repartition("row").sortWithinPartitions("row", "part", "step")
    digests = spelled.mapInArrow(_digests, "row long, groups_sha256 string")
    done = states.select("row", "doc_id").join(sums, "row", "left").join(digests, "row", "left")
    done = done.select("row", "doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return tables.keep(done, "long"), inside.select("row", "links")


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, as texts of a whole batch are large once they are Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


class Tally:
    """Different pairs of ids and how often each was added; what is new is folded in before it gets long."""

    def __init__(self) -> None:
        self.pairs = self.counts = _NONE
        self.fresh: list[np.ndarray] = []
        self.waiting = self.added = 0

    def add(self, links: list[np.ndarray]) -> None:
        for own in links:
            self.fresh.append(own)
            self.waiting += len(own)
            self.added += len(own)
            if self.waiting >= FOLDED:
                self.fold()

    def fold(self) -> None:
        pairs, counts = np.unique(np.concatenate([_NONE, *self.fresh]), return_counts=True)
        both, places = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        # each side holds a pair once
        total[places[: len(self.pairs)]] += self.counts
        total[places[len(self.pairs) :]] += counts
        self.pairs, self.counts, self.fresh, self.waiting = both, total, [], 0


def _gathered(batches: Iterator[tuple[pa.RecordBatch, list[np.ndarray]]], most: int) -> Iterator[pa.RecordBatch]:
    """Rows with links in chunks: each chunk's different pairs of ids with their number, then its rows."""
    chunk, rows, tally = TaskContext.get().partitionId() << 32, [], Tally()

    def sent() -> Iterator[pa.RecordBatch]:
        tally.fold()
        pairs = tally.pairs
        numbers = [pa.array(np.full(len(pairs), chunk)), pa.array(pairs), pa.array(tally.counts, pa.int64())]
        nothing = [pa.nulls(len(pairs), field.type) for field in rows[0].schema]
        yield pa.RecordBatch.from_arrays(numbers + nothing, ["chunk", "pair", "k", *_ROW])
        for batch in rows:
            numbers = [pa.array(np.full(batch.num_rows, chunk)), *[pa.nulls(batch.num_rows, pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays(numbers + batch.columns, ["chunk", "pair", "k", *_ROW])

    for batch, links in batches:
        if not batch.num_rows:
            continue
        rows.append(batch)
        tally.add(links)
        if tally.added >= most:
            yield from sent()
            chunk, rows, tally = chunk + 1, [], Tally()
    if rows:
        yield from sent()


def _with_links(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in _sliced(batches):
        yield batch, [_unzipped(raw) for raw in batch.column("links").to_pylist() if raw]


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks: the counts of a chunk's pairs come first, then its rows."""
    chunk, parts, lookup = None, [], None
    for batch in batches:
        own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "kind")]
        borders = np.flatnonzero((own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])) + 1
        rows, n_best, total = [], [], []
        for begin, end in zip([0, *borders], [*borders, batch.num_rows], strict=True):
            if begin == end:
                continue
            if own[0][begin] != chunk:
                chunk, parts, lookup = own[0][begin], [], None
            part = batch.slice(begin, end - begin)
            if own[1][begin] == 0:
                parts.append([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair", "count", "best")])
                continue
            if lookup is None:
                lookup = [np.concatenate(x) for x in zip(*parts, strict=True)] or [_NONE] * 3
                order = np.argsort(lookup[0])
                parts, lookup = [], [x[order] for x in lookup]
            for row, raw in zip(part.column("row").to_pylist(), part.column("links").to_pylist(), strict=True):
                places = np.searchsorted(lookup[0], _unzipped(raw))
                rows.append(row)
                total.append(int(lookup[1][places].sum()))
                n_best.append(int(lookup[2][places].sum()))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, n_best, total)], ["row", "n_best", "count_sum"])


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(docs: DataFrame, tokenizers: tuple[str, str] | None = None, size: int = RANGE, fan: int = FAN, chunk_links: int = LINKS) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    tables, paths = Written(docs.sparkSession, "alignment"), tokenizers or default_tokenizers()
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    longer = F.coalesce(F.length("text") > size, F.lit(False))
    schema = f"chunk long, pair long, k long, row long, links binary, doc_id long, {_DONE}, groups_sha256 string"
    short = tables.keep(texts.filter(~longer).mapInArrow(_whole_documents(paths, chunk_links), schema), "short")
    long, more_links = _long_documents(texts.filter(longer), tables, paths, size, fan)
    nothing = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    more_links = more_links.filter("links IS NOT NULL").select("row", "links", *nothing, F.lit(None).cast("string").alias("groups_sha256"))
    more = tables.keep(more_links.mapInArrow(lambda batches: _gathered(_with_links(batches), chunk_links), schema), "more")

    # the chunks of both tables bear a number each
    dealt = short.withColumn("long", F.lit(0)).unionByName(more.withColumn("long", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.col("chunk") * 2 + F.col("long"))
    asked = dealt.filter("pair IS NOT NULL").select("chunk", "pair", "k")
    counts = tables.keep(asked.groupBy("pair").agg(F.sum("k").alias("count")), "counts")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    known = counts.withColumn("b", b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    answers = asked.select("chunk", "pair").join(known, "pair").select("chunk", F.lit(0).alias("kind"), "pair", "count", "best", F.lit(None).cast("long").alias("row"), F.lit(None).cast("binary").alias("links"))
    empty = [F.lit(None).cast("long").alias(c) for c in ("pair", "count", "best")]
    rows = dealt.filter("links IS NOT NULL").select("chunk", F.lit(1).alias("kind"), *empty, "row", "links")
    cells = answers.unionByName(rows).repartition("chunk").sortWithinPartitions("chunk", "kind")
    weights = cells.mapInArrow(_weighed, "row long, n_best long, count_sum long")
    weights = weights.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    done = short.filter("pair IS NULL").select(*long.columns).unionByName(long).join(weights, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
