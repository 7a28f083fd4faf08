"""Near-duplicate documents by circulant MinHash, confirmed on full shingle sets.

Two permutations of the 32-bit numbers make the whole signature: the first scatters the shingles, the second, shifted
circularly by a further step, gives one coordinate after the other. Coordinates are banded; documents that share a band
are candidates, and every link rests on the exact Jaccard similarity of the full sets.

No group is expanded into pairs. Equal sets are one class from the start. In each bucket all members are compared with
its smallest id only; then, where a bucket still holds more than one component, members of the smaller ones are compared
with the whole of each larger one, in blocks of bounded size. Buckets that hold many components are cut into blocks, and
each pair of blocks is searched inside one task by the shingles its members share; only links that join components leave
it. So a bucket that is one component costs one comparison a member, and no link between members of a bucket is left out.

Nulls and odd input: a null or blank text has no shingles and is linked with nothing; a null doc_id is its own row, with
a null component, and kept; repeated rows each get their row; other columns are not looked at; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written
from .graph import components
from .shingles import SHINGLE, WordHashes, shingle_set

BANDS, ROWS = 28, 4
SIMILAR = 75
#: Members of a class and probes that one comparison cell holds at most, on average.
BLOCK = 1000
#: Components of a bucket up to which its members are tried against whole components.
NARROW = 16
_STEP = np.uint32(0x9E3779B1)
_PIECE = 128


def _mixed(x: np.ndarray, spare: np.ndarray, first: int, second: int) -> None:
    """A permutation of the 32-bit numbers, in place."""
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, np.uint32(first), out=x)
    np.right_shift(x, np.uint32(15), out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, np.uint32(second), out=x)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of a set of 64-bit shingle hashes: the minima of the shifted second permutation."""
    low = np.full(size, 0xFFFFFFFF, np.uint32)
    shift = (np.arange(size, dtype=np.uint32) * _STEP)[:, None]
    for at in range(0, len(shingles), _PIECE):
        part = shingles[at : at + _PIECE]
        scattered = (part ^ (part >> np.uint64(32))).astype(np.uint32)
        _mixed(scattered, np.empty_like(scattered), 0x85EBCA6B, 0xC2B2AE35)
        x = scattered[None, :] + shift
        _mixed(x, np.empty_like(x), 0x7FEB352D, 0x846CA68B)
        np.minimum(low, x.min(axis=1), out=low)
    return low


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """64-bit bucket names of each row's bands."""
    cells = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), cells.shape[:2]).copy()
    for k in range(rows):
        out = (out ^ cells[:, :, k]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = WordHashes()
    for batch in batches:
        counts, prints, signs = [], [], []
        for text in batch.column("text").to_pylist():
            shingles = shingle_set(text, held)
            counts.append(len(shingles))
            prints.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
            signs.append(signature(shingles, BANDS * ROWS))
        keys = band_keys(np.array(signs, np.uint32).reshape(len(signs), -1)).view(np.int64)
        ends = pa.array(np.arange(0, len(signs) * BANDS + 1, BANDS, dtype=np.int32))
        bands = pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), bands], ["doc_id", "n_shingles", "print", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = WordHashes()
    for batch in batches:
        found = [shingle_set(text, held).tobytes() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "shingles"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted cells: the probes of a cell come first, then its members stream past them."""
    cell, probes = None, []
    for batch in batches:
        u, v = [], []
        cells = zip(*(batch.column(c).to_pylist() for c in ("class", "i", "j")), strict=True)
        for at, side, name, raw in zip(cells, batch.column("side").to_pylist(), batch.column("id").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
            if at != cell:
                cell, probes = at, []
            own = np.frombuffer(raw, np.uint64)
            if side == 0:
                probes.append((name, own))
                continue
            for other, theirs in probes:
                few, many = sorted((len(own), len(theirs)))
                if 100 * few < SIMILAR * many or other == name:
                    continue
                places = np.searchsorted(own, theirs)
                places[places == len(own)] = 0
                shared = int((own[places] == theirs).sum())
                if 100 * shared >= SIMILAR * (few + many - shared):
                    u.append(other)
                    v.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def joining(roots: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of places whose sets are similar and whose roots differ, as many as it takes to join those roots."""
    sizes = np.array([len(s) for s in sets])
    shingles, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(numbers, kind="stable")]
    begins = np.searchsorted(np.sort(numbers), np.arange(len(shingles) + 1))
    places = np.concatenate([[0], np.cumsum(sizes)])
    label, found = np.unique(np.array(roots), return_inverse=True)[1], []
    for x in range(len(sets)):
        if (label == label[x]).all():
            break
        lists = [holders[begins[n] : begins[n + 1]] for n in numbers[places[x] : places[x + 1]]]
        shared = np.bincount(np.concatenate(lists), minlength=len(sets))
        for y in np.flatnonzero((100 * shared >= SIMILAR * (sizes[x] + sizes - shared)) & (label != label[x])):
            if label[y] != label[x]:
                found.append((x, int(y)))
                label[label == label[y]] = label[x]
    return found


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted cells of bounded size; each is searched when it is complete."""
    cell, rows = None, []

    def search() -> pa.RecordBatch:
        pairs = joining([r[1] for r in rows], [np.frombuffer(r[2], np.uint64) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([rows[p[k]][0] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        cells = zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j")), strict=True)
        for at, *row in zip(cells, *(batch.column(c).to_pylist() for c in ("id", "root", "shingles")), strict=True):
            if at != cell and rows:
                yield search()
                rows = []
            cell = at
            rows.append(row)
    if rows:
        yield search()


def _within(part: DataFrame, wide: DataFrame, sets: DataFrame) -> DataFrame:
    """Links u, v that join components inside the buckets of ``wide`` (bucket, blocks)."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = part.join(wide, "bucket").select("bucket", "id", F.col("rank.root").alias("root"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.join(sets, "id").select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "root", "shingles")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_joined, "u long, v long")


def _linked(probes: DataFrame, members: DataFrame, sets: DataFrame, tables: Written, name: str) -> DataFrame:
    """Links u, v between each probe (class, id) and the members (class, id) of its class, on full sets.

    A class with many probes or members is cut into blocks of each, and every pair of blocks is a cell of its own.
    """
    sizes = lambda rows, name: rows.groupBy("class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    grid = tables.keep(sizes(probes, "np").join(sizes(members, "nm"), "class"), f"{name}-grid")
    side = lambda rows, own, other, n: (
        rows.join(grid, "class").join(sets, "id")
        .withColumn(own, F.pmod(F.xxhash64("id"), F.col("np" if own == "i" else "nm")).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col("nm" if own == "i" else "np") - 1)))
        .select("class", "i", "j", F.lit(n).alias("side"), "id", "shingles")
    )
    cells = side(probes, "i", "j", 0).unionByName(side(members, "j", "i", 1))
    cells = cells.repartition("class", "i", "j").sortWithinPartitions("class", "i", "j", "side")
    return tables.keep(cells.mapInArrow(_compared, "u long, v long"), name)


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    tables = Written(docs.sparkSession, "minhash")
    texts = docs.select(F.col("`doc_id`").cast("long").alias("id"), F.col("`text`").cast("string").alias("text"))
    signed = texts.select(F.col("id").alias("doc_id"), "text").mapInArrow(_signed, "doc_id long, n_shingles long, print binary, bands array<long>")
    signed = tables.keep(signed, "signed")
    linked = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "print", "bands")
    # one row for each different set, in the bucket of each of its bands; only buckets of two or more matter
    firsts = tables.keep(linked.groupBy("print").agg(F.min("id").alias("id")), "firsts")
    different = tables.keep(linked.join(firsts, ["id", "print"], "left_semi").select("id", "bands"), "different")
    entries = different.select(F.explode("bands").alias("bucket"), "id")
    buckets = entries.groupBy("bucket").agg(F.min("id").alias("class"), F.max("id").alias("last"))
    buckets = tables.keep(buckets.filter("class < last").select("bucket", "class"), "buckets")
    entries = tables.keep(entries.join(buckets, "bucket"), "entries")
    needed = entries.select("id").distinct()
    sets = texts.join(needed, "id", "left_semi").mapInArrow(_sets, "id long, shingles binary")
    sets = tables.keep(sets.dropDuplicates(["id"]), "sets")
    tables.drop("different", "buckets")

    probes = tables.keep(entries.filter("id > class").select("class", "id").distinct(), "probes")
    pivots = probes.select("class").distinct().select("class", F.col("class").alias("id"))
    links = _linked(probes, pivots, sets, tables, "links")
    roots = components(links)

    # buckets that still hold more than one component: members of each smaller one are tried against each larger one
    placed = entries.select("bucket", "id").join(tables.keep(roots, "roots"), "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    placed = tables.keep(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("bucket")
    members = placed.select(F.col("root").alias("class"), "id").distinct()
    sizes = members.groupBy("class").agg(F.count("*").alias("size"))
    part = placed.join(tables.keep(mixed, "mixed"), "bucket", "left_semi").join(tables.keep(sizes.withColumnRenamed("class", "root"), "sizes"), "root")
    part = tables.keep(part.select("bucket", "id", F.struct((-F.col("size")).alias("less"), "root").alias("rank")), "part")
    others = tables.keep(part.groupBy("bucket", F.col("rank").alias("other")).agg(F.count("*").alias("n")), "others")
    wide = others.groupBy("bucket").agg(F.count("*").alias("roots"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    wide = tables.keep(wide.filter(F.col("roots") > NARROW).select("bucket", "blocks"), "wide")
    narrow = part.join(wide.select("bucket"), "bucket", "left_anti")
    again = narrow.join(others.drop("n"), "bucket").filter("other < rank").select(F.col("other.root").alias("class"), "id").distinct()
    again = tables.keep(again, "again")
    whole = members.join(again.select("class").distinct(), "class", "left_semi").select("class", "id")
    more = _linked(again, whole, sets, tables, "more").unionByName(tables.keep(_within(part, wide, sets), "within"))
    tables.drop("entries", "sets", "probes", "mixed", "sizes", "part", "others", "again")

    # the later links join components, so it is those that are linked
    joined = more.join(members.select(F.col("id").alias("u"), F.col("class").alias("a")), "u").join(members.select(F.col("id").alias("v"), F.col("class").alias("b")), "v")
    joined = tables.keep(components(joined.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()), "joined")
    lasting = members.join(joined.select(F.col("id").alias("class"), F.col("root").alias("top")), "class", "left").select("id", F.coalesce("top", "class").alias("root"))
    by_print = tables.keep(firsts.join(lasting, "id", "left").select("print", F.coalesce("root", "id").alias("root")), "by_print")
    tables.drop("placed", "joined", "more", "within", "links", "roots")
    found = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print")).join(by_print, "print", "left")
    component = F.coalesce("root", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest id. Repeated rows of that id stay as they are."""
    mark = "minhash_" + "_".join(docs.columns)[:200]
    gone = classes(docs).filter("NOT kept").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[mark], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
