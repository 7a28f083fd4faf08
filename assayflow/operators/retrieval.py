"""Vector, keyword and fused retrieval for one question or a whole batch of them."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import fixed_values as V
from ..functions import text as T
from ..session import cut_lineage
from .keyed import top_per_key

#: Queries, and chunks, of a cell.
QUERY_BLOCK, CHUNK_BLOCK = 1024, 65_536


def filtered_chunks(
    chunks: DataFrame, filings: DataFrame, *, title: str | None = None, doc_type: str | None = None,
    date_from: date | None = None, date_to: date | None = None,
) -> DataFrame:
    """Chunks of filings passing the metadata filter; predicates exist only when set."""
    rows = filings
    if title:
        needle = "%" + title.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        rows = rows.filter(F.col("title").ilike(needle))
    if doc_type:
        rows = rows.filter(F.col("doc_type") == doc_type)
    if date_from:
        rows = rows.filter(F.col("filed_at") >= F.lit(date_from))
    if date_to:
        rows = rows.filter(F.col("filed_at") <= F.lit(date_to))
    return chunks.join(rows.select("document_id", "title", "doc_type", "filed_at"), "document_id")


def merge_filters(pinned: dict, asked: dict) -> dict:
    """Filters of a question over the pinned defaults; blanks do not override."""
    return {**pinned, **{k: v for k, v in asked.items() if v not in (None, "")}}


# --- vector arm --------------------------------------------------------------------------------


def vector_hits(chunks: DataFrame, queries: DataFrame, limit: int = V.ARM_LIMIT, block: int = QUERY_BLOCK, chunk_block: int = CHUNK_BLOCK) -> DataFrame:
    """The nearest chunks of each query by cosine distance, exact.

    ``queries`` holds query_id and embedding. Queries and chunks are cut into blocks by a hash of their id;
    every pair of blocks is a cell, in which a matrix product scores chunks against the block's queries and
    ``limit`` rows per query remain. The numbers of blocks are subqueries of the one plan, so nothing runs
    while it is built and a task holds one block of queries, whatever the sizes.
    """
    parts = lambda rows, size: rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int")).scalar()
    asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding")
    stored = chunks.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    query_type, chunk_type = (rows.schema[0].dataType for rows in (asked, stored))
    n, m = parts(asked, block), parts(stored, chunk_block)
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    own = lambda name, count: F.pmod(F.xxhash64(name), count).cast("int")
    left = asked.select(own("query_id", n).alias("qb"), every(m).alias("cb"), F.lit(0).alias("side"), "query_id", F.lit(None).cast(chunk_type).alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    right = stored.select(every(n).alias("qb"), own("chunk_id", m).alias("cb"), F.lit(1).alias("side"), F.lit(None).cast(query_type).alias("query_id"), "chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    cells = left.unionByName(right).repartition("qb", "cb").sortWithinPartitions("qb", "cb", "side")
    hits = cells.mapInArrow(_nearest(limit), StructType([StructField("query_id", query_type), StructField("chunk_id", chunk_type), StructField("distance", DoubleType())]))
    return top_per_key(hits, ["query_id"], [F.col("distance"), F.col("chunk_id")], limit, "rank")


def _nearest(limit: int):
    """Sorted cells: the queries of a cell first, then its chunks stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, rows, matrix, kept = None, [], [], None, []
        types = {}

        def flush() -> pa.RecordBatch:
            out = [(q, c, d) for q, found in zip(ids, kept) for d, c in found]
            columns = list(zip(*out)) if out else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], types["query_id"]), pa.array(columns[1], types["chunk_id"]), pa.array(columns[2], pa.float64())], ["query_id", "chunk_id", "distance"])

        for batch in batches:
            types = {c: batch.schema.field(c).type for c in ("query_id", "chunk_id")}
            marks = np.stack([batch.column(c).to_numpy() for c in ("qb", "cb", "side")], axis=1)
            edges = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]).any(axis=1)])) if len(marks) else []
            for a, b in zip(edges, [*edges[1:], len(marks)]):
                at = tuple(marks[a, :2])
                if at != cell:
                    if kept:
                        yield flush()
                    cell, ids, rows, matrix, kept = at, [], [], None, []
                vectors = np.array(batch.column("embedding").slice(a, b - a).to_pylist(), dtype=np.float64)
                if marks[a, 2] == 0:
                    ids += batch.column("query_id").slice(a, b - a).to_pylist()
                    rows.append(vectors)
                    continue
                if not ids:
                    continue
                if matrix is None:
                    matrix = np.concatenate(rows)
                    matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
                    kept = [[] for _ in ids]
                norms = np.linalg.norm(vectors, axis=1)
                usable = norms > 0
                names = np.array(batch.column("chunk_id").slice(a, b - a).to_pylist())[usable]
                distances = 1.0 - (vectors[usable] / norms[usable][:, None]) @ matrix.T
                if not len(distances):
                    continue
                edge = np.partition(distances, min(limit, len(distances)) - 1, axis=0)[min(limit, len(distances)) - 1]
                near = distances <= edge
                for q in range(len(ids)):
                    found = list(zip(distances[near[:, q], q].tolist(), names[near[:, q]].tolist()))
                    kept[q] = sorted(kept[q] + found)[:limit]
        if kept:
            yield flush()

    return run


# --- keyword arm -------------------------------------------------------------------------------


def postings(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``word, chunk_id, tf`` for the words of a vocabulary. Suffixes are cut from a chunk's distinct words, not from each occurrence.

    Words are counted inside their text, in sorted order, so no table of all words of all chunks is held: only those of the vocabulary are grouped.

    Texts are dealt by chunk before they are cut into words: both counts then stay where the chunk is, and a file of few
    row groups does not leave the cutting to few tasks.
    """
    dealt = chunks.select("chunk_id", "content").repartition("chunk_id")
    sorted_words = dealt.select("chunk_id", F.array_sort(T.plain_words("content")).alias("ws")).filter(F.size("ws") > 0)
    last = F.filter(F.sequence(F.lit(1), F.size("ws")), lambda i: (i == F.size("ws")) | (F.get("ws", i - 1) != F.get("ws", i)))
    runs = sorted_words.withColumn("ends", last)
    entry = lambda end, k: F.struct(F.get("ws", end - 1).alias("plain"), (end - F.coalesce(F.get("ends", k - 1), F.lit(0))).alias("n"))
    counted = runs.select("chunk_id", F.explode(F.transform("ends", entry)).alias("e"))
    words = counted.select("chunk_id", T.stem(F.col("e.plain")).alias("word"), "e.n")
    return words.join(vocabulary, "word", "left_semi").groupBy("chunk_id", "word").agg(F.sum("n").alias("tf"))


def keyword_hits(chunks: DataFrame, queries: DataFrame, limit: int = V.ARM_LIMIT) -> DataFrame:
    """Chunks holding every word of a query, ranked by the summed term weight ln(1 + count).

    A query meets only the chunks on the list of its rarest word; whether such a chunk holds the others too is
    looked up in the chunk's own counts. A word that stands nowhere is the rarest of all, and its query meets none. The lists are written
    once and read for each of the three uses.
    """
    asked = queries.select("query_id", F.array_distinct(T.words("query_text")).alias("ws")).filter(F.size("ws") > 0)
    terms = asked.select("query_id", F.explode("ws").alias("word"))
    lists = cut_lineage(postings(chunks, terms.select("word").distinct()))
    often = lists.groupBy("word").agg(F.count("*").alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)), "word")
    leads = terms.join(often, "word", "left").groupBy("query_id").agg(F.min_by("word", rarity).alias("word"))
    met = leads.join(lists.select("word", "chunk_id"), "word").select("query_id", "chunk_id")
    held = lists.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "tf"))).alias("held"))
    rows = met.join(asked, "query_id").join(held, "chunk_id").filter(F.size(F.array_except("ws", F.map_keys("held"))) == 0)
    weight = F.aggregate("ws", F.lit(0.0), lambda total, w: total + F.log1p(F.element_at("held", w)))
    full = rows.select("query_id", "chunk_id", F.round(weight, 6).alias("weight"))
    return top_per_key(full, ["query_id"], [F.col("weight").desc(), F.col("chunk_id")], limit, "rank")


# --- fusion --------------------------------------------------------------------------------------


def fuse(vector: DataFrame, keyword: DataFrame, limit: int = V.FUSED_LIMIT, k: int = V.FUSION_K, boost: Column | None = None) -> DataFrame:
    """Reciprocal-rank fusion of the two arms per query; ``boost`` adds to the fused score."""
    v = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"))
    t = keyword.select("query_id", "chunk_id", F.col("rank").alias("text_rank"))
    both = v.join(t, ["query_id", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    score = part("vector_rank") + part("text_rank")
    scored = both.withColumn("score", score if boost is None else score + boost)
    return top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], limit, "place")


def recency(filed_at: Column, as_of: date, weight: float = 0.005, tau_days: float = 365.0) -> Column:
    """A small addition for newer filings that fades with age; off unless asked for."""
    age = F.greatest(F.lit(0), F.date_diff(F.lit(as_of), filed_at))
    return F.coalesce(F.lit(weight) * F.exp(-age / F.lit(tau_days)), F.lit(0.0))


def hybrid(chunks: DataFrame, queries: DataFrame, limit: int = V.FUSED_LIMIT, arm_limit: int = V.ARM_LIMIT) -> DataFrame:
    """Fused hits of many queries with the chunk's document, pages and text."""
    fused = fuse(vector_hits(chunks, queries, arm_limit), keyword_hits(chunks, queries, arm_limit), limit)
    shown = chunks.select("chunk_id", "document_id", "page_start", "page_end", "content")
    return fused.join(shown, "chunk_id")


def document_pages(chunks: DataFrame, first: int | None = None, last: int | None = None, limit: int = 20) -> DataFrame:
    """Chunks of each document inside a page range, the first ``limit`` per document."""
    rows = chunks
    if first is not None:
        rows = rows.filter(F.coalesce("page_end", "page_start") >= first)
    if last is not None:
        rows = rows.filter(F.col("page_start") <= last)
    return top_per_key(rows, ["document_id"], [F.col("chunk_index")], limit, "place")


# --- quality -------------------------------------------------------------------------------------


def retrieval_quality(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """hit@1, hit@3, hit@8 and the mean reciprocal rank of a batch.

    ``hits`` holds query_id, place, document_id and pages; ``expected`` query_id, document_id and
    the pages that answer. A hit counts when document and pages overlap.
    """
    ranks = first_correct(hits, expected)
    within = lambda n: F.count_if(F.col("first_rank") <= n).alias(f"hit_{n}")
    mrr = F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))
    return ranks.agg(F.count("*").alias("questions"), within(1), within(3), within(8), mrr.alias("mrr"))


def first_correct(hits: DataFrame, expected: DataFrame) -> DataFrame:
    want = expected.select("query_id", "document_id", F.col("page_start").alias("_a"), F.col("page_end").alias("_b"))
    overlap = (F.col("page_start") <= F.col("_b")) & (F.col("page_end") >= F.col("_a"))
    right = hits.join(want, ["query_id", "document_id"]).filter(overlap).groupBy("query_id").agg(F.min("place").alias("first_rank"))
    return expected.select("query_id").distinct().join(right, "query_id", "left")


def documents_holding(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, document_id) of documents whose content holds a passage (query_id, passage) of three words or more.

    A passage is looked for only where the rarest of its inner words stands, so it meets few documents;
    words are cut at single spaces, as inner words of the passage stand between spaces in the text too.
    """
    inner = F.expr("slice(split(passage, ' '), 2, greatest(0, size(split(passage, ' ')) - 2))")
    asked = passages.select("query_id", F.explode(F.array_distinct(inner)).alias("word"))
    held = documents.select("document_id", F.explode(F.array_distinct(F.split("content", " "))).alias("word"))
    held = held.join(asked.select("word").distinct(), "word", "left_semi")
    often = held.groupBy("word").agg(F.count("*").alias("n"))
    rarest = asked.join(often, "word").groupBy("query_id").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    met = held.join(rarest, "word").select("query_id", "document_id")
    texts = met.join(passages.select("query_id", "passage"), "query_id").join(documents.select("document_id", "content"), "document_id")
    return texts.filter(F.contains("content", F.col("passage"))).select("query_id", "document_id").distinct()


def expected_pages(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Pages whose text matches a question's answer pattern inside its document."""
    rows = chunks.join(questions.select("query_id", "document_id", "answer"), "document_id")
    return rows.filter(F.regexp_like("content", F.concat(F.lit("(?i)"), "answer"))).select(
        "query_id", "document_id", "page_start", F.coalesce("page_end", "page_start").alias("page_end")
    ).distinct()


# --- approximate candidates and half precision ------------------------------------------------------


def _sign_keys(frame: DataFrame, key: str, bands: int, bits: int, seed: int) -> DataFrame:
    """Band keys of random-hyperplane signatures: equal keys mean a small angle is likely."""
    key_type = frame.schema[key].dataType.simpleString()

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for batch in batches:
            if batch.empty:
                continue
            rows = np.stack([np.asarray(e, dtype=np.float32) for e in batch["embedding"]])
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((rows.shape[1], bands * bits)).astype(np.float32)
            signs = (rows @ planes > 0).reshape(len(rows), bands, bits)
            keys = signs @ (1 << np.arange(bits))
            yield pd.DataFrame(
                {key: np.repeat(batch[key].to_numpy(), bands), "band": np.tile(np.arange(bands), len(rows)), "slot": keys.reshape(-1)}
            )

    rows = frame.filter(F.col("embedding").isNotNull()).select(key, "embedding")
    return rows.mapInPandas(signatures, f"{key} {key_type}, band int, slot long")


def approximate_hits(chunks: DataFrame, queries: DataFrame, limit: int = V.ARM_LIMIT, bands: int = 16, bits: int = 6, seed: int = 7) -> DataFrame:
    """Candidates sharing a signature band with the query, ranked by exact distance.

    Approximate: recall is measured against ``vector_hits``. Only candidates' vectors are read
    back, and candidate ids meet by an equality join on (band, slot).
    """
    near = _sign_keys(chunks, "chunk_id", bands, bits, seed)
    asked = _sign_keys(queries, "query_id", bands, bits, seed)
    pairs = asked.join(near, ["band", "slot"]).select("query_id", "chunk_id").distinct()
    rows = pairs.join(chunks.select("chunk_id", "embedding"), "chunk_id").join(
        queries.select("query_id", F.col("embedding").alias("query_embedding")), "query_id"
    )
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    cosine = dot(F.col("embedding"), F.col("query_embedding")) / F.sqrt(
        dot(F.col("embedding"), F.col("embedding")) * dot(F.col("query_embedding"), F.col("query_embedding"))
    )
    scored = rows.select("query_id", "chunk_id", (1 - cosine).alias("distance"))
    return top_per_key(scored, ["query_id"], [F.col("distance"), F.col("chunk_id")], limit, "rank")


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    found = exact.select("query_id", "chunk_id").join(approximate.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    counted = exact.groupBy("query_id").agg(F.count("*").alias("wanted")).join(
        found.groupBy("query_id").agg(F.count("*").alias("found")), "query_id", "left"
    )
    return counted.withColumn("recall", F.coalesce("found", F.lit(0)) / F.col("wanted"))


def half_precision(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors rounded to half precision, kept as floats."""

    @F.pandas_udf("array<float>")
    def rounded(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, dtype=np.float16).astype(np.float32))

    return rows.withColumn(column, rounded(column))
