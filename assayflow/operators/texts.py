"""Text operators: page quality, sections, chunking, chunk selection, near duplicates, chats."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.columns import contains_any, strip
from .keyed import first_per_key

# --- pages and sections ------------------------------------------------------------------------


def page_quality(pages: DataFrame, budget: int = V.OCR_PAGES) -> DataFrame:
    """Low-text pages of a document: the first ones read by OCR up to the budget, others skipped.

    ``ocr_text`` is what a reader returned (blank when it failed); only pages that gave text use
    the budget. The running count is taken over the low-text pages alone.
    """
    low = T.is_low_text("text")
    readable = F.coalesce(strip("ocr_text") != "", F.lit(False))
    before = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    flagged = pages.withColumn("low_text", low).withColumn("_read", low & readable)
    used = F.coalesce(F.sum(F.col("_read").cast("int")).over(before), F.lit(0))
    done = flagged.withColumn("_used", used)
    was_read = F.col("_read") & (F.col("_used") < budget)
    return done.withColumn("was_ocr", was_read).withColumn("ocr_skipped", F.col("low_text") & ~was_read).drop("_read", "_used")


def with_sections(blocks: DataFrame, order: Sequence[str] = ("page", "position")) -> DataFrame:
    """The heading in force at each block: the last heading at or before it in the document."""
    upto = Window.partitionBy("document_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.last(T.heading("text"), ignorenulls=True).over(upto))


CHUNK_SCHEMA = "document_id {key}, chunk_index int, page_start int, page_end int, content string, section_title string"


def _packed(blocks: Iterable[tuple], target: int, overlap: int) -> Iterator[tuple]:
    """Chunks (first page, last page, content, section) of one document's blocks (page, text, is_table, section).

    Only lengths decide: a block that would take the open chunk past ``target`` begins a new one, which
    starts with the last ``overlap`` characters of the one before. A table longer than a chunk does not
    share one even with that overlap, which then stands alone. A chunk has the section of the block that
    closed it.
    """
    held, length, pages, section = [], 0, [], None
    for page, text, is_table, section in blocks:
        ends = 0 if length + len(text) <= target else 2 if is_table and len(text) > target else 1
        while held and ends:
            content = "\n\n".join(held).strip()
            if content:
                yield pages[0] or 1, pages[-1] or pages[0] or 1, content, section
            held = [content[-overlap:]] if content else []
            length, pages, ends = sum(map(len, held)), [page], ends - 1
        held.append(text)
        length += len(text)
        pages = [*pages[:1], page]
    content = "\n\n".join(held).strip()
    if content:
        yield pages[0] or 1, pages[-1] or pages[0] or 1, content, section


def chunk_blocks(blocks: DataFrame, target: int = V.CHUNK_CHARS, overlap: int = V.OVERLAP_CHARS) -> DataFrame:
    """Blocks (document_id, page, position, text, is_table) to overlapping chunks.

    Sections come from a window first. Packing depends on what was packed before, so it runs in
    document order inside each partition as a stream: rows arrive sorted in Arrow batches and
    only the open chunk of the current document is held, whatever the size of the document.
    """
    key = blocks.schema["document_id"].dataType.simpleString()
    ordered = (
        with_sections(blocks.withColumn("text", T.without_nuls("text")))
        .select("document_id", "page", "position", "text", "is_table", "section")
        .repartition("document_id")
        .sortWithinPartitions("document_id", "page", "position")
    )

    columns = ["document_id", "chunk_index", "page_start", "page_end", "content", "section_title"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (
            (document, (int(page), text or "", bool(table), title))
            for batch in batches
            for document, page, text, table, title in zip(
                batch["document_id"], batch["page"], batch["text"], batch["is_table"], batch["section"].where(batch["section"].notna(), None)
            )
        )
        chunks = (
            (document, number, *chunk)
            for document, own in groupby(rows, key=itemgetter(0))
            for number, chunk in enumerate(_packed(map(itemgetter(1), own), target, overlap))
        )
        while part := list(islice(chunks, 1000)):
            yield pd.DataFrame(part, columns=columns)

    return ordered.mapInPandas(pack, CHUNK_SCHEMA.format(key=key))


def embedding_batches(chunks: DataFrame, max_texts: int = V.BATCH_TEXTS, max_tokens: int = V.BATCH_TOKENS) -> DataFrame:
    """Greedy request batches per document, bounded by texts and by estimated tokens.

    Streams in chunk order like the chunker: only two counters are held.
    """
    key = chunks.schema["document_id"].dataType.simpleString()
    ordered = (
        chunks.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), T.estimated_tokens("content").alias("tokens"))
        .repartition("document_id")
        .sortWithinPartitions("document_id", "chunk_index")
    )

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, number, texts, used = None, 0, 0, 0
        for batch in batches:
            numbers = []
            for document, tokens in zip(batch["document_id"], batch["tokens"]):
                if document != current:
                    current, number, texts, used = document, 0, 0, 0
                if texts and (texts >= max_texts or used + tokens > max_tokens):
                    number, texts, used = number + 1, 0, 0
                texts, used = texts + 1, used + tokens
                numbers.append(number)
            yield batch.assign(batch_no=numbers)

    return ordered.mapInPandas(assign, f"document_id {key}, chunk_index long, tokens long, batch_no int")


# --- choosing chunks ---------------------------------------------------------------------------


def _first_overflow(rows: DataFrame, size: Column, budget: int, always_first: bool) -> DataFrame:
    """Rows of each document before the running size first passes the budget."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sized = rows.withColumn("_run", F.sum(size).over(upto)).withColumn("_nth", F.row_number().over(order))
    fits = F.col("_run") <= budget
    if always_first:
        fits = fits | (F.col("_nth") == 1)
    return sized.filter(fits).drop("_run", "_nth")


def select_chunks(chunks: DataFrame, hints: Sequence[str], budget: int = V.SECTION_BUDGET) -> DataFrame:
    """Chunks whose title or opening names a hint, else those naming it anywhere, packed in order.

    Sizes are never negative, so packing stops where the running sum first passes the budget,
    and that is the same set as a running-sum filter.
    """
    title, content = F.lower(F.coalesce("section_title", F.lit(""))), F.lower(F.coalesce("content", F.lit("")))
    near = contains_any(F.concat(title, F.lit(" "), F.left(content, F.lit(500))), hints)
    anywhere = contains_any(F.concat(title, F.lit(" "), content), hints)
    hits = chunks.withColumn("_near", near).filter(anywhere)
    best = hits.groupBy("document_id").agg(F.max("_near").alias("_any_near"))
    chosen = hits.join(best, "document_id").filter(F.col("_near") | ~F.col("_any_near")).drop("_near", "_any_near")
    return _first_overflow(chosen, F.length(F.coalesce("content", F.lit(""))), budget, always_first=True)


def first_pages(chunks: DataFrame, pages: int, fallback: int = 3) -> DataFrame:
    """Chunks ending on the first pages; a document without any gives its first three chunks."""
    early = F.coalesce(F.col("page_end"), F.lit(1)) <= pages
    has = chunks.groupBy("document_id").agg(F.max(early).alias("_has"))
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    kept = chunks.filter(early)
    lacking = chunks.join(has.filter(~F.col("_has")).select("document_id"), "document_id", "left_semi")
    first = lacking.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= fallback).drop("_n")
    return kept.unionByName(first)


def assembled_context(chunks: DataFrame) -> DataFrame:
    """One text per document: page and section header before each chunk, in order.

    Run on selected chunks, whose total size the selection budget bounds.
    """
    start = F.coalesce(F.col("page_start").cast("string"), F.lit("?"))
    end = F.coalesce(F.col("page_end").cast("string"), start)
    header = F.concat(F.lit("[p."), start, F.lit("-"), end, F.lit(" | "), F.coalesce("section_title", F.lit("")), F.lit("]"))
    part = F.concat(header, F.lit("\n"), F.coalesce("content", F.lit("")))
    pieces = F.array_sort(F.collect_list(F.struct("chunk_index", part.alias("text"))))
    return chunks.groupBy("document_id").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "\n\n").alias("context"), F.count("*").alias("chunks")
    )


# --- near duplicates ----------------------------------------------------------------------------


def near_duplicates(chunks: DataFrame, scope: str = "project_id", threshold: float = V.NEAR_DUPLICATE, known: DataFrame | None = None) -> DataFrame:
    """Pairs of distinct fingerprint sets inside a scope with Jaccard similarity at the threshold.

    A fingerprint is the hash of a chunk's opening. Documents with equal sets are folded into one
    first (``copies`` counts them), so copies never pair with one another. The rest meet by prefix
    filtering, which is exact: sets as similar as the threshold must share one of their rarest
    few members, so a boilerplate chunk shared by a third of all documents is hardly ever joined
    on.
    """
    marks = chunks.select(scope, "document_id", T.fingerprint("content").alias("mark")).filter("mark IS NOT NULL").distinct()
    sets = marks.groupBy(scope, "document_id").agg(F.array_sort(F.collect_set("mark")).alias("marks"))
    if known is not None:
        sets = sets.join(known.select("document_id").distinct().withColumn("_known", F.lit(True)), "document_id", "left")
    else:
        sets = sets.withColumn("_known", F.lit(True))
    folded = sets.groupBy(scope, F.xxhash64("marks").alias("_h"), "marks").agg(
        F.min("document_id").alias("document_id"), F.count("*").alias("copies"), F.max(F.coalesce("_known", F.lit(False))).alias("known")
    ).withColumn("size", F.size("marks"))
    members = folded.select(scope, "document_id", "size", F.explode("marks").alias("mark"))
    rarity = members.groupBy(scope, "mark").agg(F.count("*").alias("df"))
    ranked = members.join(rarity.filter("df > 1"), [scope, "mark"])
    # Marks no other set holds cannot be shared; they count towards the prefix length all the same.
    shared = ranked.groupBy(scope, "document_id").agg(F.count("*").alias("n_shared"))
    order = Window.partitionBy(scope, "document_id").orderBy("df", "mark")
    placed = ranked.join(shared, [scope, "document_id"]).withColumn("rn", F.row_number().over(order) + F.col("size") - F.col("n_shared"))
    prefix = placed.filter(F.col("rn") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).select(scope, "mark", "document_id", "size")
    a = prefix.select(scope, "mark", F.col("document_id").alias("left_id"), F.col("size").alias("left_size"))
    b = prefix.select(scope, "mark", F.col("document_id").alias("right_id"), F.col("size").alias("right_size"))
    fits = (F.col("left_id") < F.col("right_id")) & (
        F.least("left_size", "right_size") >= F.lit(threshold) * F.greatest("left_size", "right_size") - 1e-9
    )
    candidates = a.join(b, [scope, "mark"]).filter(fits).select(scope, "left_id", "right_id").distinct()
    left = folded.select(scope, F.col("document_id").alias("left_id"), F.col("marks").alias("left_marks"))
    right = folded.select(scope, F.col("document_id").alias("right_id"), F.col("marks").alias("right_marks"))
    checked = candidates.join(left, [scope, "left_id"]).join(right, [scope, "right_id"])
    common = F.size(F.array_intersect("left_marks", "right_marks"))
    jaccard = common / (F.size("left_marks") + F.size("right_marks") - common)
    return checked.select(scope, "left_id", "right_id", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def near_duplicate_flags(chunks: DataFrame, scope: str = "project_id", threshold: float = V.NEAR_DUPLICATE, known: DataFrame | None = None) -> DataFrame:
    """Documents that repeat another document of their scope which already has facts.

    ``known`` lists documents with facts (all when omitted). A document is flagged when another
    document with the same fingerprints is known, or a near set holds a known document.
    """
    marks = chunks.select(scope, "document_id", T.fingerprint("content").alias("mark")).filter("mark IS NOT NULL").distinct()
    sets = marks.groupBy(scope, "document_id").agg(F.array_sort(F.collect_set("mark")).alias("marks")).withColumn("set_key", F.sha2(F.array_join("marks", ""), 256))
    have = known.select("document_id").distinct().withColumn("_known", F.lit(1)) if known is not None else None
    rows = sets.join(have, "document_id", "left") if have is not None else sets.withColumn("_known", F.lit(1))
    rows = rows.select(scope, "document_id", "set_key", F.coalesce("_known", F.lit(0)).alias("has_facts"))
    groups = rows.groupBy(scope, "set_key").agg(F.min("document_id").alias("head"), F.sum("has_facts").alias("facts"))
    pairs = near_duplicates(chunks, scope, threshold)
    both = pairs.select(scope, F.col("left_id").alias("head"), F.col("right_id").alias("other")).unionByName(
        pairs.select(scope, F.col("right_id").alias("head"), F.col("left_id").alias("other"))
    )
    facts = groups.select(scope, F.col("head").alias("other"), F.col("facts").alias("other_facts"))
    near = both.join(facts, [scope, "other"]).filter("other_facts > 0").select(scope, "head").distinct().withColumn("_near", F.lit(True))
    judged = rows.join(groups, [scope, "set_key"]).join(near, [scope, "head"], "left")
    same = F.col("facts") - F.col("has_facts") > 0
    return judged.select(scope, "document_id", (same | F.coalesce("_near", F.lit(False))).alias("near_duplicate"))


# --- citations and chats -------------------------------------------------------------------------


def inline_citations(messages: DataFrame, keys: Sequence[str] = ("conv_id", "turn"), text: str = "text") -> DataFrame:
    """Citations in the order written, one per label and conversation."""
    scope, turn = keys
    found = messages.select(*keys, F.posexplode(T.citations(text)).alias("pos", "c")).select(*keys, "pos", "c.*")
    once = first_per_key(found, [scope, "label"], F.struct(turn, "pos"))
    return once.withColumn("href", T.citation_link("document_id", "page_start"))


def citations_not_inline(messages: DataFrame, text: str = "text", stored: str = "cited") -> DataFrame:
    """Labels a message's metadata cites although its text does not."""
    extra = F.array_except(F.col(stored), T.citation_labels(text))
    return messages.withColumn("extra", extra)


def chat_titles(messages: DataFrame, limit: int = 80) -> DataFrame:
    """Title of each conversation: its first user text, cut with an ellipsis."""
    first = messages.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("t"))
    text = strip(F.coalesce("t", F.lit("")))
    cut = F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)
    return first.select("conv_id", F.when(text == "", F.lit("New chat")).otherwise(cut).alias("title"))
