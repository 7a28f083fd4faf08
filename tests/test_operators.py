import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from assayflow.functions import text as T
from assayflow.operators import evaluate as E
from assayflow.operators import keyed, landing, ledger, listing
from assayflow.operators import retrieval as R
from assayflow.operators import review as V
from assayflow.operators import texts as X
from assayflow.streaming import jobs as K


def test_ordered_index_on_a_hot_group(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 7) END AS k", "id % 11 AS v")
    got = keyed.ordered_index(rows, [F.col("v").desc(), F.col("id").asc()], by=["k"], total="v").collect()
    groups: dict = {}
    for r in got:
        groups.setdefault(r.k, []).append(r)
    for members in groups.values():
        members.sort(key=lambda r: (-r.v, r.id))
        assert [r.position for r in members] == list(range(len(members)))
        assert [r.running for r in members] == list(np.cumsum([r.v for r in members]))


def test_landing_twice_adds_nothing(spark):
    rows = spark.createDataFrame([("s", "1", "h1", 1), ("s", "1", "h2", 2), ("s", "2", "h1", 3), ("s", "3", "h3", 4)], "source string, external_id string, sha256 string, n int")
    empty = rows.limit(0)
    first = landing.land_new(rows, empty, F.col("n"))
    assert sorted(r.n for r in first.collect()) == [1, 4]
    assert landing.land_new(rows, first, F.col("n")).count() == 0


HEADS = [(r"item 14 resources", True), ("XI. Mineral Resource Estimates", True), ("14.1 Mineral Resource", True), ("an ordinary line", False), ("x" * 121, False)]


@pytest.mark.parametrize("text, is_head", HEADS)
def test_headings(spark, text, is_head):
    got = spark.range(1).select(T.heading(F.lit(text + "\nmore")).alias("h")).first().h
    assert (got == text) if is_head else got is None


def test_chunks_of_stated_blocks(spark):
    """Target 20, overlap 4: what opens a chunk, what it carries over, its pages and its section."""
    blocks = {
        "short": [(1, "aaaa", False), (2, "bbbb", False)],
        "full": [(1, "a" * 15, False), (2, "bbbbbb", False), (3, "cc", False)],
        "table": [(1, "intro text", False), (2, "t" * 25, True), (2, "after", False)],
        "first table": [(4, "t" * 25, True)],
        "headed": [(1, "Item 3 Area\n" + "x" * 8, False), (1, "Item 4 Other\n" + "y" * 8, False)],
        "blank": [(1, "  ", False), (2, "", False)],
    }
    want = {
        "short": [(0, 1, 2, "aaaa\n\nbbbb", None)],
        "full": [(0, 1, 1, "a" * 15, None), (1, 2, 3, "aaaa\n\nbbbbbb\n\ncc", None)],
        "table": [(0, 1, 1, "intro text", None), (1, 2, 2, "text", None), (2, 2, 2, "text\n\n" + "t" * 25, None), (3, 2, 2, "tttt\n\nafter", None)],
        "first table": [(0, 4, 4, "t" * 25, None)],
        "headed": [(0, 1, 1, "Item 3 Area\n" + "x" * 8, "Item 4 Other"), (1, 1, 1, "xxxx\n\nItem 4 Other\n" + "y" * 8, "Item 4 Other")],
    }
    rows = [(d, p, i, t, table) for d, bs in blocks.items() for i, (p, t, table) in enumerate(bs)]
    frame = spark.createDataFrame(rows, "document_id string, page int, position int, text string, is_table boolean")
    got = {}
    for r in X.chunk_blocks(frame, target=20, overlap=4).collect():
        got.setdefault(r.document_id, []).append((r.chunk_index, r.page_start, r.page_end, r.content, r.section_title))
    assert {d: sorted(c) for d, c in got.items()} == want


def test_every_block_is_in_its_documents_chunks(spark):
    rng = random.Random(3)
    rows = [(d, 1 + i // 5, i, f"{d}:{i}:" + "w" * rng.randint(1, 160), rng.random() < 0.2) for d in range(12) for i in range(rng.randint(1, 60))]
    frame = spark.createDataFrame(rows, "document_id int, page int, position int, text string, is_table boolean")
    chunks = {}
    for r in sorted(X.chunk_blocks(frame, target=120, overlap=15).collect(), key=lambda r: (r.document_id, r.chunk_index)):
        chunks.setdefault(r.document_id, []).append(r)
    for d, own in chunks.items():
        assert [c.chunk_index for c in own] == list(range(len(own)))
        assert all(b.content.startswith(a.content[-15:].lstrip()) for a, b in zip(own, own[1:]))
        for _, page, _, text, _ in (r for r in rows if r[0] == d):
            assert any(text in c.content and c.page_start <= page <= c.page_end for c in own)


def test_embedding_batches(spark):
    rows = [(1, i, "x" * n) for i, n in enumerate([40, 40, 400, 4000, 4, 4, 4, 4])]
    table = spark.createDataFrame(rows, "document_id int, chunk_index int, content string")
    got = X.embedding_batches(table, max_texts=3, max_tokens=110).orderBy("chunk_index").collect()
    assert [r.batch_no for r in got] == [0, 0, 1, 2, 3, 3, 3, 4]


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(5)
    docs = {}
    for d in range(60):
        base = docs[rng.randrange(d)] if d and rng.random() < 0.5 else [f"t{rng.randrange(200)}" for _ in range(rng.randint(1, 9))]
        docs[d] = [t if rng.random() > 0.15 else f"n{rng.randrange(9999)}" for t in base] + ["boilerplate"]
    rows = [("p", d, t) for d, ts in docs.items() for t in ts]
    table = spark.createDataFrame(rows, "project_id string, document_id int, content string")
    sets = {d: frozenset(ts) for d, ts in docs.items()}
    close = lambda a, b: len(a & b) / len(a | b) >= 0.6
    known = {d for d in docs if d % 2 == 0}
    facts = spark.createDataFrame([(d,) for d in known], "document_id int")
    want = {d: any(o != d and o in known and close(sets[d], sets[o]) for o in docs) for d in docs}
    got = {r.document_id: r.near_duplicate for r in X.near_duplicate_flags(table, known=facts).collect()}
    assert got == want
    heads = {}
    for d, s in sets.items():
        heads.setdefault(s, d)
    firsts = sorted(heads.values())
    pairs = {(a, b) for a in firsts for b in firsts if a < b and close(sets[a], sets[b])}
    assert {(r.left_id, r.right_id) for r in X.near_duplicates(table).collect()} == pairs


def test_greedy_match_equals_plain_walk(spark):
    rng = random.Random(9)
    ref = [(1, f"r{i:03d}", rng.choice("ab"), round(rng.choice([100, 101, 103, 250, 900]) * rng.uniform(0.99, 1.01), 3)) for i in range(60)]
    new = [(1, f"n{i:03d}", rng.choice("ab"), round(rng.choice([100, 101, 103, 250, 900]) * rng.uniform(0.99, 1.01), 3)) for i in range(60)]
    schema = "document_id int, row_id string, category string, tonnes double"
    used, want = set(), set()
    for _, rid, cat, size in sorted(ref, key=lambda r: r[1]):
        for _, nid, ncat, nsize in sorted(new, key=lambda r: r[1]):
            if nid not in used and ncat == cat and abs(size - nsize) <= 0.02 * max(size, nsize):
                used.add(nid)
                want.add((rid, nid))
                break
    got = {(r.ref_id, r.cand_id) for r in E.match_rows(spark.createDataFrame(ref, schema), spark.createDataFrame(new, schema)).collect()}
    assert got == want


def test_vector_hits_equal_brute_force_over_blocks(spark):
    rng = np.random.default_rng(1)
    points, asked = rng.standard_normal((300, 8)).astype(np.float32), rng.standard_normal((7, 8)).astype(np.float32)
    chunks = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "chunk_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(asked)], "query_id long, embedding array<float>")
    norm = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    distance = 1 - norm(asked.astype(np.float64)) @ norm(points.astype(np.float64)).T
    want = {(q, int(c)) for q in range(7) for c in np.argsort(distance[q])[:10]}
    for block in (1024, 3):
        got = {(r.query_id, r.chunk_id) for r in R.vector_hits(chunks, queries, limit=10, block=block).collect()}
        assert got == want
    near = R.approximate_hits(chunks, queries, limit=10, bands=24, bits=3)
    assert R.recall(near, R.vector_hits(chunks, queries, limit=10)).agg(F.avg("recall")).first()[0] > 0.9


def test_fusion_is_the_stated_formula(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, rank int")
    t = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in R.fuse(v, t).collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 62})


def test_half_precision(spark):
    got = R.half_precision(spark.createDataFrame([([0.1, 1.0],)], "embedding array<float>")).first().embedding
    assert got == [float(np.float16(0.1)), 1.0]


FACT = "fact_id string, document_id string, category string, tonnes double, grade map<string,double>, contained_metal map<string,double>, reviewed boolean"


def verified(spark, text, **changes):
    base = dict(fact_id="f", document_id="d", category="indicated", tonnes=12_345_678.0, grade={"Au_gpt": 1.25}, contained_metal={}, reviewed=False)
    base.update(changes)
    chunks = spark.createDataFrame([("c", "d", 0, text)], "chunk_id string, document_id string, chunk_index int, content string")
    return V.verify_resources(spark.createDataFrame([tuple(base.values())], FACT), chunks).first().verified


def test_resource_figures_must_stand_together(spark):
    assert verified(spark, "Indicated 12,345,678 t at 1.25 g/t")
    assert verified(spark, "Indicated 12 345 678 t at 1.25 g/t")
    assert verified(spark, "Indicated\u00a012,345.678 kt at 1.25 g/t")
    assert not verified(spark, "Inferred 12,345,678 t at 1.25 g/t")
    assert not verified(spark, "Indicated 112,345,678 t at 1.25 g/t")
    assert not verified(spark, "Indicated 12,345,678 t at 11.25 g/t")
    assert not verified(spark, "Indicated 12,345,678 t" + " " * 170 + "1.25 g/t")
    assert not verified(spark, "Indicated ........ 12\nIndicated 12,345,678 t at 1.25")
    assert not verified(spark, "Indicated 12,345,678 t at 1.25 g/t", grade={"Au_gpt": 125.0})
    assert not verified(spark, "Indicated 12,345,678 t at 1.25 g/t", contained_metal={"Au_oz": 9.0})
    assert verified(spark, "Indicated 12,345,678 t", grade={})


def test_first_overflow_stops_packing(spark):
    rows = [(1, i, None, "mineral resource " + "x" * n) for i, n in enumerate([50, 80, 5])]
    table = spark.createDataFrame(rows, "document_id int, chunk_index int, section_title string, content string")
    assert [r.chunk_index for r in X.select_chunks(table, ("mineral resource",), budget=100).collect()] == [0]
    assert [r.chunk_index for r in X.select_chunks(table, ("mineral resource",), budget=10).collect()] == [0]


def test_tiers_and_full_extraction(spark):
    as_of = date(2026, 11, 30)
    rows = [("old", "p", "c", "pea", date(2023, 11, 30)), ("new", "p", "c", "pea", date(2026, 10, 31)), ("none", "p", "c", "pea", None), ("last", "q", "c", "pea", date(2020, 1, 1))]
    filings = spark.createDataFrame(rows, "document_id string, project_id string, company_id string, doc_type string, filed_at date")
    nothing = spark.createDataFrame([], "project_id string, company_id string")
    got = {r.document_id: (r.tier, r.reason, r.full_extract) for r in ledger.full_extraction(filings, nothing, as_of).collect()}
    assert got == {"old": ("backfill", "superseded", False), "new": ("live", "live", True), "none": ("live", "undated", True), "last": ("backfill", "latest", True)}
    watched = spark.createDataFrame([(None, "c")], "project_id string, company_id string")
    assert all(r.full_extract for r in ledger.full_extraction(filings, watched, as_of).collect())


def test_guarded_select(spark):
    table = spark.range(3).toDF("company_id")
    assert listing.guarded_select(spark, "WITH x AS (SELECT company_id FROM v_companies) SELECT count(*) AS n FROM x;", {"v_companies": table}).first().n == 3
    for bad in ("DELETE FROM v_companies", "SELECT 1; SELECT 2", "SELECT * FROM secrets", "SELECT * FROM v_companies WHERE 1 = (SELECT 1 FROM information_schema.tables)", "SELECT * FROM v_companies, secrets",
                "SELECT * FROM range(5)", "SHOW TABLES", "SELECT (SELECT max(id) FROM secrets) FROM v_companies", "FROM secrets SELECT *", "SELECT 1 FROM v_companies WHERE EXISTS (SELECT 1 FROM secrets)"):
        with pytest.raises(ValueError):
            listing.guarded_select(spark, bad, {"v_companies": table})


def test_guard_leaves_no_views(spark):
    spark.range(2).createOrReplaceTempView("secrets")
    table = spark.range(3).toDF("company_id")
    before = {t.name for t in spark.catalog.listTables()}
    rows = listing.guarded_select(spark, "SELECT c.company_id FROM v_companies c JOIN v_companies d USING (company_id) ORDER BY 1 DESC", {"v_companies": table})
    assert [r.company_id for r in rows.collect()] == [2, 1, 0]
    with pytest.raises(ValueError):
        listing.guarded_select(spark, "SELECT * FROM v_companies, secrets", {"v_companies": table})
    assert {t.name for t in spark.catalog.listTables()} == before
    spark.catalog.dropTempView("secrets")


def test_missing_tonnes_pair_by_place(spark):
    shape = "document_id int, row_id string, category string, tonnes double"
    old = spark.createDataFrame([(1, "a", "inferred", None), (1, "b", "inferred", 100.0), (1, "c", "inferred", 0.0)], shape)
    new = spark.createDataFrame([(1, "x", "inferred", None), (1, "y", "inferred", 101.0), (1, "z", "inferred", 0.0), (1, "zz", "inferred", None)], shape)
    got = sorted((r.ref_id, r.cand_id) for r in E.match_rows(old, new).collect())
    assert got == [("a", "x"), ("b", "y"), ("c", "z")]


def test_first_decision_counts(spark):
    facts = spark.createDataFrame([("f", False, 1.0)], "fact_id string, reviewed boolean, tonnes double")
    for order in ((1, 2), (2, 1)):
        rows = [("resource", "f", "approve", None, None, order[0]), ("resource", "f", "delete", None, None, order[1])]
        decisions = spark.createDataFrame(rows, "kind string, id string, action string, note string, fields map<string,string>, seq int")
        assert V.apply_decisions(facts, decisions, "resource").count() == (order[0] == 1)
        kinds = facts.withColumn("kind", F.lit("resource"))
        assert dict(map(tuple, V.decision_counts(kinds, decisions).collect())) == {"approve" if order[0] == 1 else "delete": 1, "skipped": 1}


def test_vector_hits_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(150, 6))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, [0.0] * 6), (901, None)], "chunk_id int, embedding array<double>")
    queries = table.filter("chunk_id < 25").select(F.concat(F.lit("q"), "chunk_id").alias("query_id"), "embedding")
    got = {}
    for r in R.vector_hits(table, queries, limit=7, block=4, chunk_block=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(25):
        assert [c for _, c in sorted(got[f"q{q}"])] == np.argsort(1 - unit @ unit[q], kind="stable")[:7].tolist()


def test_keyword_hits_equal_plain_counting(spark):
    rng = random.Random(3)
    vocabulary = ["assays", "assay", "drilling", "drilled", "zone", "zones", "gold", "ore", "mines", "companies", "the", "x9"]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) + (" gold." if i % 2 else "")) for i in range(150)] + [(900, None), (901, "")]
    queries = [("a", "gold"), ("b", "assay drill"), ("c", "Zones, gold; company"), ("d", "gold nowhere"), ("e", "the"), ("f", ""), ("g", None), ("h", "gold gold ore")]

    def stems(text):
        out = []
        for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split():
            if len(w) > 1 and w not in T.STOP_WORDS:
                if len(w) > 4:
                    w = w[:-3] + "y" if w.endswith("ies") else w
                    w = w[:-3] if w.endswith("ing") else w[:-2] if w.endswith("ed") else w
                    w = w.removesuffix("s")
                out.append(w)
        return out

    wanted = []
    for name, text in queries:
        asked = set(stems(text))
        found = [(-round(sum(np.log1p(stems(t).count(w)) for w in asked), 6), i) for i, t in texts if asked and asked <= set(stems(t))]
        wanted += [(name, rank, i) for rank, (_, i) in enumerate(sorted(found)[:40], 1)]
    got = R.keyword_hits(spark.createDataFrame(texts, "chunk_id int, content string"), spark.createDataFrame(queries, "query_id string, query_text string")).collect()
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got) == sorted(wanted) and {w[0] for w in wanted} == {"a", "b", "c", "h"}


def test_landing_stream_keeps_each_filing_once(spark, tmp_path):
    folder, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    folder.mkdir()
    schema = "source string, external_id string, sha256 string, doc_id long, seen_at timestamp"

    def add(name, rows):
        table = spark.createDataFrame(rows, "source string, external_id string, sha256 string, doc_id long, seen string")
        table.withColumn("seen_at", F.col("seen").cast("timestamp")).drop("seen").coalesce(1).write.parquet(str(folder / name))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(folder))
        K.run_available(*K.landing_job(stream, store), checkpoint)
        return sorted(r.doc_id for r in K.read_batches(spark, store, K.LANDED).collect())

    add("one", [("s", "1", "h1", 1, "2026-01-01"), ("s", "1", "h1", 2, "2026-01-01"), ("s", "2", "h2", 3, "2026-01-01")])
    assert len(run()) == 2
    add("two", [("s", "2", "h2", 4, "2026-03-01"), ("s", "3", "h1", 5, "2026-03-01"), ("s", "4", "h4", 6, "2026-03-01")])
    assert run()[-1] == 6 and len(run()) == 3


def test_landing_opens_the_parts_of_its_own_keys(spark, tmp_path):
    columns = "source string, external_id string, sha256 string, doc_id long, seen_at timestamp"
    rows = lambda ids, day: spark.createDataFrame([("s", str(n), f"h{n}", n, datetime(2026, 1, day)) for n in ids], columns)
    store = str(tmp_path / "store")
    _, land = K.landing_job(rows([1], 1), store)
    land(rows(range(200), 20), 0)
    part = lambda frame, *c: {r[0] for r in frame.select(K.key_part(K.PARTS, *c)).collect()}
    late = rows([5, 500], 1)
    opened = {"store": part(late, "source", "external_id"), "store-hashes": part(late, "sha256")}
    # a file that is no Parquet, wherever the batch has nothing to look for
    for folder, parts in opened.items():
        for file in (tmp_path / folder / "batch_id=0").rglob("*.parquet"):
            if int(file.parent.name.split("=")[1]) not in parts:
                file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
                file.write_bytes(b"not to be read")
    land(late, 1)
    land(late, 1)
    # 5 is known, and 500 lands although its time is far behind
    assert [r.doc_id for r in spark.read.parquet(f"{store}/batch_id=1").collect()] == [500]


def test_deliveries_are_exactly_once(spark, tmp_path):
    columns = "event_id long, project_id long, event_type string, event_date date, created_at timestamp"
    alert = spark.createDataFrame([(7, 1, "email", "a@b")], "alert_id long, user_id int, channel string, address string")
    items = spark.createDataFrame([(5, 1, 10, None), (6, 1, None, 3), (8, 2, 10, None)], "item_id int, watchlist_id int, project_id long, company_id long")
    lists = spark.createDataFrame([(1, 1), (2, 1)], "watchlist_id int, user_id int").withColumn("last_seen_at", F.lit(None).cast("timestamp"))
    projects = spark.createDataFrame([(10, 3, "P"), (11, 3, "Q")], "project_id long, company_id long, name string")
    inbox, store, checkpoint = (str(tmp_path / n) for n in ("in", "log", "cp"))

    def add(*events):
        rows = [(n, project, "x", date(2026, 1, day), datetime(2026, 1, day)) for n, project, day in events]
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(inbox)

    def run(fail=False):
        events = spark.readStream.schema(columns).parquet(inbox)
        once, deliver = K.alert_job(events, alert, items, lists, projects, store)

        def broken(batch, batch_id):
            deliver(batch, batch_id)
            raise RuntimeError("lost after the log was written")

        K.run_available(once, broken if fail else deliver, checkpoint)
        return sorted((r.alert_id, r.event_id) for r in K.read_batches(spark, store, K.DELIVERED).collect())

    add((1, 10, 1), (2, 11, 2), (2, 11, 2))
    assert run() == [(7, 1), (7, 2)]
    add((1, 10, 1), (3, 10, 3))
    with pytest.raises(StreamingQueryException):
        run(fail=True)
    # the batch is done again; then an event arrives out of order, one over again, and one on a project nobody watches
    assert run() == [(7, 1), (7, 2), (7, 3)]
    add((4, 11, 1), (3, 10, 3), (5, 99, 3))
    assert run() == [(7, 1), (7, 2), (7, 3), (7, 4)]



def test_figures_meet_numbers_on_leading_digits(spark, monkeypatch):
    """Every form of a figure is found, rounded up or grouped by blanks too, and facts are not multiplied by their forms."""
    value = 9_999_600.4
    forms = spark.range(1).select(V.printed_forms(F.lit(value), (1.0, 1e-3, 1e-6), 2).alias("f")).first().f
    texts = [f"see {form} t" for form in forms] + ["see 9,999.6004 t", "see 19 999 600 t", "see 9 999 600.5 t", "see 10 t or 100"]
    chunks = spark.createDataFrame([(1, n, text) for n, text in enumerate(texts)], "document_id long, chunk_id int, content string")
    anchors = spark.createDataFrame([("a", 1, forms), ("b", 2, forms)], "fact_id string, document_id long, forms array<string>")
    leads = []
    joined = V._lead
    monkeypatch.setattr(V, "_lead", lambda c: leads.append(c) or joined(c))
    hits = V.figure_hits(anchors, chunks).collect()
    assert {(h.fact_id, h.chunk_id) for h in hits} == {("a", n) for n in range(len(forms))}
    assert leads and anchors.select(F.size(F.array_distinct(F.transform("forms", lambda f: joined(F.substring_index(f, " ", 1)))))).first()[0] < len(forms) / 2
