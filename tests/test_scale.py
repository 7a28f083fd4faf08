"""What queries shuffle and keep, beside the right rows."""

import pytest
from pyspark.sql import functions as F

from assayflow.operators import evaluate as E
from assayflow.operators import history as H
from assayflow.operators import keyed
from assayflow.operators import resolve as R
from assayflow.operators import retrieval
from assayflow.operators import review as V
from assayflow.plans import catalog


@pytest.fixture
def shuffled(spark):
    """Bytes that an action writes to shuffles."""
    context, jvm = spark.sparkContext._jsc.sc(), spark._jvm

    def total():
        context.listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        stages = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList()).iterator()
        found = 0
        while stages.hasNext():
            found += stages.next().shuffleWriteBytes()
        return found

    def run(frame):
        before = total()
        rows = frame.collect()
        return rows, total() - before

    return run


def count(frame, word):
    return frame._jdf.queryExecution().executedPlan().toString().count(word)


def shuffles(frame):
    return count(frame, "Exchange hashpartitioning")


DRILLS = "drill_id string, project_id long, hole_id string, from_m double, to_m double, interval_m double, assays map<string,double>"


def test_best_holes_are_found_without_shuffling_all_rows(spark, shuffled):
    """only rows that can be in a list travel."""
    rows = spark.range(40_000).selectExpr(
        "lpad(id * 7919 % 40000, 6, '0') AS drill_id", "id DIV 10 AS project_id", "CASE WHEN id % 4 <> 0 THEN concat('H', id % 3) END AS hole_id",
        "0D AS from_m", "1.0D + id % 97 AS to_m", "cast(NULL AS double) AS interval_m",
        "map('Au_gpt', 1.0D + id * 31 % 101, 'Cu_pct', 1.0D + id * 17 % 89) AS assays",
    ).localCheckpoint()
    got, size = shuffled(H.rank_intercepts_by_key(rows).select("key", "rank", "drill_id"))
    score = {k: rows.select("*", (F.col("assays")[k] * F.col("to_m")).alias("s")).collect() for k in ("Au_gpt", "Cu_pct")}
    for key, own in score.items():
        holes = {}
        for r in own:
            at = (r.project_id, r.hole_id or r.drill_id)
            holes[at] = min(holes.get(at, (0, "")), (-r.s, r.drill_id))
        assert [r.drill_id for r in sorted(got, key=lambda r: r["rank"]) if r.key == key] == [d for _, d in sorted(holes.values())[:8]]
    # 80,000 scored rows of more than 10 bytes
    assert size < 800_000


def test_a_figure_that_is_no_number_ranks_as_in_a_descending_order(spark):
    """NaN is the highest score of its hole, and of the list."""
    rows = [("a", 1, "H", 0.0, 2.0, None, {"Au_gpt": 5.0}), ("b", 1, "H", 0.0, 2.0, None, {"Au_gpt": float("nan")}), ("c", 2, "H", 0.0, 2.0, None, {"Au_gpt": 9.0})]
    table = spark.createDataFrame(rows, DRILLS)
    assert [r.drill_id for r in H.rank_intercepts_by_key(table, ("Au_gpt",)).orderBy("rank").collect()] == ["b", "c"]
    assert [r.drill_id for r in H.rank_intercepts(table, "Au_gpt", limit=1, per_hole=True).collect()] == ["b"]


RESOURCES = (
    "estimate_id string, project_id string, document_id string, effective_date date, filed_at date, category string, domain string, "
    "tonnes double, grade map<string,double>"
)


def test_estimates_deal_rows_once_by_document(spark):
    """F14, F16: the date, the cells and the document are worked out where the rows are."""
    rows, filings = spark.createDataFrame([], RESOURCES), spark.createDataFrame([], "document_id string, filed_at date")
    assert shuffles(H.estimates(rows, filings)) <= 2


def test_zones_join_rows_with_nothing(spark):
    """rows travel once, then documents, dates and zones."""
    rows, filings = spark.createDataFrame([], RESOURCES), spark.createDataFrame([], "document_id string, filed_at date")
    for made in (H.zone_matrix(rows, filings), H.zone_changes(rows, filings)):
        assert shuffles(made) <= 4 and count(made, "Join") == 0


def test_files_and_index_are_each_cut_once(spark):
    """numbers and names are marks of one join."""
    files = spark.createDataFrame([], "document_id long, archive string, document string, company string, profile_number string, size_bytes long")
    index = spark.createDataFrame([], "document string, profile_name string, profile_number string, submitted_date date, submitted_time string, file_size_kb long")
    assert shuffles(R.match_files(files, index)) <= 7


def test_rows_of_a_class_are_matched_where_they_are_sorted(spark):
    """runs and the walk need no shuffle of their own."""
    schema = "document_id long, row_id long, category string, tonnes double"
    assert shuffles(E.match_rows(spark.createDataFrame([], schema), spark.createDataFrame([], schema))) <= 5


def test_overlap_groups_each_value_once(spark):
    """both sides are marked and grouped together."""
    names = spark.createDataFrame([(1, "A"), (1, "a"), (2, "b")], "document_id long, name string")
    other = spark.createDataFrame([(1, "a"), (1, None), (3, "c")], "document_id long, name string")
    made = E.set_overlap(names, other)
    assert shuffles(made) <= 2
    assert sorted(map(tuple, made.collect())) == [(1, 1, 2, 1), (2, 1, 0, 0), (3, 0, 1, 0)]


def test_words_are_counted_inside_their_text(spark):
    """only words of the vocabulary are grouped."""
    texts = spark.createDataFrame([(1, "Ores, ore and GOLD ore"), (2, None), (3, ""), (4, "gold")], "chunk_id long, content string")
    made = retrieval.postings(texts, spark.createDataFrame([("ore",), ("gold",), ("ores",)], "word string"))
    assert count(made, "HashAggregate") <= 2
    assert sorted(map(tuple, made.select("chunk_id", "word", "tf").collect())) == [(1, "gold", 1), (1, "ore", 2), (1, "ores", 1), (4, "gold", 1)]


FACT = "fact_id string, document_id string, category string, tonnes double, grade map<string,double>, contained_metal map<string,double>, reviewed boolean"
CHUNK = "chunk_id string, document_id string, chunk_index int, content string"


def only_dealt_by_document(frame):
    return 0 < shuffles(frame) == count(frame, "Exchange hashpartitioning(document_id")


def test_figures_are_checked_where_documents_are(spark):
    """F4 of round 4: facts and chunks are dealt by document, and nothing is dealt by number, chunk or fact after that."""
    rows = [("a", "d", "indicated", 12_345_678.0, {"Au_gpt": 1.25}, {}, False), ("b", "d", "indicated", 12_345_678.0, {"Au_gpt": 9.0}, {}, False)]
    rows += [("a", "e", "indicated", 12_345_678.0, {}, {}, False), ("c", None, "indicated", 5.0, {}, {}, False), ("c", None, "indicated", 5.0, {}, {}, False)]
    text = "Indicated 12,345,678 t, " + ",".join(map(str, range(100, 20_000))) + " and indicated 12 345 678 t at 1.25 g/t"
    chunks = spark.createDataFrame([("k", "d", 0, text), ("k", "f", 0, text), ("n", "d", 1, None)], CHUNK)
    made = V.verify_resources(spark.createDataFrame(rows, FACT), chunks)
    assert only_dealt_by_document(made)
    got = sorted(map(tuple, made.select("fact_id", F.coalesce("document_id", F.lit("")).alias("d"), "verified").collect()))
    assert got == [("a", "d", True), ("a", "e", False), ("b", "d", False), ("c", "", False), ("c", "", False)]


def test_places_of_a_number(spark):
    """F4 of round 4: every place of just this number, with hard characters before it."""
    rows = [("5.0 15.0 5.0, é😀5.0 5.01 5.0.", "5.0", [0, 9, 16, 25]), ("none", "5", []), ("", "5", []), (None, "5", [])]
    rows += [("é 5.0, once", "5.0", [2]), ("5.0.", "5.0", [0]), ("15.0", "5.0", []), ("5.01", "5.0", []), ("at 5.0.1", "5.0", [])]
    table = spark.createDataFrame(rows, "content string, number string, places array<int>")
    assert [r.got for r in table.select(V.number_places("content", "number").alias("got")).collect()] == [places for *_, places in rows]


def test_short_numbers_are_left_out(spark):
    """F4 of round 4: but for those that groups set off by blanks may go on from."""
    chunks = spark.createDataFrame([("c", "d", 0, "0.05 0.050 12 12 345 1,2,3 0.0 007, 100 5. 1 23")], CHUNK)
    numbers = lambda *least: {r.number for r in V.chunk_numbers(chunks, *least).collect()}
    assert numbers() == {"0.05", "0.050", "12", "345", "1,2,3", "0.0", "007", "100", "5", "1", "23"}
    assert numbers(2) == {"0.050", "12", "345", "1,2,3", "100", "23"}
    assert numbers(3) == {"12", "345", "1,2,3", "100"}


def test_forms_in_one_string_are_the_listed_forms(spark):
    """F4 of round 4: the string that travels has the forms of the list and no others."""
    values = [None, 0.0, -3.0, 0.05, 0.0995, 0.5, 9.96, 99.5, 999.4, 999.9996, 1000.0, 58444.63, 1_234_567.0, 9_999_600.4, 123_456_789.125]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    for scales, least in (((1.0,), 1), ((1.0, 1e-3, 1e-6), 2), ((1.0, 1e-3, 1e-6), 3)):
        for r in table.select("v", V.printed_forms("v", scales, least).alias("listed"), V.printed_text("v", scales, least).alias("text")).collect():
            plain = {f"{r.v * s:,.{d}f}" for s in scales for d in range(4) if r.v and r.v > 0 and (d or abs(r.v * s - round(r.v * s)) <= 1e-9)}
            plain = {t for t in plain if least <= 1 or len(t.replace(",", "").replace(".", "").lstrip("0")) >= least}
            want = plain | {t.replace(",", "") for t in plain} | {t.replace(",", " ") for t in plain}
            assert set(r.listed) == want and len(r.listed) == len(want) and set(r.text.split("|")) - {""} == want


def test_tables_dealt_by_document_meet_there(spark):
    """F4 of round 4: as a join on all keys, with repeated rows on both sides and nulls that meet nothing."""
    left = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "a", 4), (None, "a", 5), (1, None, 6)], "document_id int, k string, x int")
    right = spark.createDataFrame([(1, "a", 7.0), (1, "a", None), (2, "b", 8.0), (None, "a", 9.0), (1, None, 9.0)], "document_id int, k string, y double")
    made = keyed.joined_where_dealt(*V.by_document(left, right), ["document_id", "k"])
    assert only_dealt_by_document(made)
    assert sorted(map(repr, made.collect())) == sorted(map(repr, left.join(right, ["document_id", "k"]).collect()))


def test_resource_verdicts_shuffle_order_lines_once(spark, small, shuffled):
    """F4, F3, F2 and F1 of round 4: order lines are dealt by document, and neither joined with themselves nor dealt again."""
    for name in ("v04_verify_resources", "v07_apply_verdicts", "v12_packets"):
        made = catalog.QUERIES[name](spark, small)
        assert shuffles(made) == count(made, "Exchange hashpartitioning(l_orderkey") + count(made, "Exchange hashpartitioning(document_id")
    rows, size = shuffled(catalog.QUERIES["v07_counts"](spark, small))
    assert len(rows) == 1 and size < 700_000


def test_verdicts_meet_their_facts_where_documents_are(spark):
    """F2 of round 4: verdicts that name the document are not dealt by fact."""
    facts = spark.createDataFrame([("a", "d", False, None), ("b", "d", True, "human"), ("c", None, False, None)], "fact_id string, document_id string, reviewed boolean, review_source string")
    verdicts = spark.createDataFrame([("a", "d", True), ("b", "d", True), ("a", "e", False)], "fact_id string, document_id string, verified boolean")
    made = V.apply_verdicts(*V.by_document(facts, verdicts))
    assert only_dealt_by_document(made)
    by_fact = V.apply_verdicts(facts, verdicts.filter("document_id = 'd'").drop("document_id"))
    assert made.columns == by_fact.columns
    assert {r.fact_id: (r.reviewed, r.review_source) for r in made.collect()} == {"a": (True, "auto_source_match"), "b": (True, "human"), "c": (False, None)}
    assert sorted(map(repr, made.collect())) == sorted(map(repr, by_fact.collect()))


def test_packets_are_packed_where_documents_are(spark):
    """F1 of round 4: chunks named by figure or hole are marked and counted up to the budget in their document."""
    anchors = spark.createDataFrame([("f", "d", ["1,234"]), ("g", "e", ["1,234"])], "fact_id string, document_id string, forms array<string>")
    holes = spark.createDataFrame([("d", "H-7"), ("d", "H-7"), ("g", "H-7")], "document_id string, hole_id string")
    texts = [("d1", "d", 0, "1,234 t"), ("d2", "d", 1, "hole H-7"), ("d3", "d", 2, "11,234 t"), ("d4", "d", 3, "H-7 at 1,234 and 1,234"), ("d5", "d", 4, "1,234 over it")]
    chunks = spark.createDataFrame(texts + [("g1", "g", 0, "H-7"), ("h1", "h", 0, "H-7, 1,234")], CHUNK)
    made = V.review_packets(anchors, holes, chunks, budget=40)
    assert only_dealt_by_document(made)
    assert sorted(r.chunk_id for r in made.collect()) == ["d1", "d2", "d4", "g1"]
