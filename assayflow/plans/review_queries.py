"""Registered verification, review, evaluation, retrieval and formatting queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fmt
from ..operators import evaluate as E
from ..operators import listing as L
from ..operators import retrieval as R
from ..operators import review as V
from ..operators.keyed import deal
from ..sources import exports
from .driver_views import LINE_ID, DriverViews, duck_sql
from .registry import query
from .stream_queries import scratch

# --- retrieval -------------------------------------------------------------------------------------


def _texts(v: DriverViews):
    return v.documents.select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"),
        F.lit(0).alias("chunk_index"), F.col("text").alias("content"),
    )


def _vectors(v: DriverViews):
    return v.table("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _questions(v: DriverViews):
    vectors = v.table("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    items = v.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return items.join(vectors, "query_id")


_COSINE = """q AS (SELECT item_id AS query_id, text AS query_text, embedding::DOUBLE[] AS qe FROM benchmark JOIN embeddings ON vec_id = item_id),
vh AS (SELECT query_id, vec_id AS chunk_id, 1 - list_dot_product(embedding::DOUBLE[], qe) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(qe, qe)) AS distance FROM embeddings, q),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM vh QUALIFY rank <= 40)"""
# The fused search sees vectors of stored documents only.
_COSINE_DOCS = _COSINE.replace("FROM embeddings, q)", "FROM embeddings JOIN documents ON doc_id = vec_id, q)")
_STOP = "('a','an','and','are','as','at','be','by','for','from','has','have','in','is','it','its','of','on','or','that','the','their','this','to','was','were','which','will','with')"


def _stem(w: str) -> str:
    return f"CASE WHEN length({w}) > 4 THEN regexp_replace(regexp_replace(regexp_replace({w}, 'ies$', 'y'), '(ing|ed)$', ''), 's$', '') ELSE {w} END"


_WORDS = f"""qt AS (SELECT DISTINCT query_id, {_stem('w')} AS word FROM (SELECT query_id, unnest(regexp_split_to_array(lower(query_text), '[^a-z0-9]+')) AS w FROM q) WHERE length(w) > 1 AND w NOT IN {_STOP}),
qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1),
tf AS (SELECT doc_id AS chunk_id, {_stem('w')} AS word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE length(w) > 1 AND w NOT IN {_STOP} GROUP BY ALL),
th AS (SELECT query_id, chunk_id, round(sum(ln(1 + tf)), 6) AS weight FROM tf JOIN qt USING (word) JOIN qn USING (query_id) GROUP BY query_id, chunk_id, n HAVING count(*) = n),
tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, chunk_id) AS rank FROM th QUALIFY rank <= 40)"""
_FUSED = """fused AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.chunk_id, t.chunk_id) AS chunk_id, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0) AS score
  FROM vr v FULL JOIN tr t ON v.query_id = t.query_id AND v.chunk_id = t.chunk_id),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS place FROM fused QUALIFY place <= 8)"""


@query("r01_cosine", duck_sql("SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, round(distance, 6) AS distance FROM vr", ctes=_COSINE))
def _(v: DriverViews):
    return R.vector_hits(_vectors(v), _questions(v)).withColumn("distance", F.round("distance", 6))


@query("r02_keyword", duck_sql("SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, weight FROM tr", ctes=_COSINE + "," + _WORDS))
def _(v: DriverViews):
    return R.keyword_hits(_texts(v), _questions(v))


def _hybrid(v: DriverViews):
    chunks = _texts(v).join(_vectors(v), "chunk_id", "left")
    return R.hybrid(chunks, _questions(v))


@query("r03_fusion", duck_sql("SELECT query_id, chunk_id, place, round(score, 8) AS score FROM top JOIN documents ON doc_id = chunk_id", ctes=",".join((_COSINE_DOCS, _WORDS, _FUSED))))
def _(v: DriverViews):
    return _hybrid(v).select("query_id", "chunk_id", "place", F.round("score", 8).alias("score"))


@query(
    "r04_filtered",
    duck_sql(
        """SELECT d.doc_id AS chunk_id, f.doc_type, f.filed_at FROM documents d JOIN filings f ON f.document_id = d.doc_id
           WHERE f.title ILIKE '%block 1%' AND f.doc_type = 'pea' AND f.filed_at BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
        "filings",
    ),
)
def _(v: DriverViews):
    from datetime import date

    asked = R.merge_filters({"doc_type": "pea", "title": "other"}, {"title": "block 1", "doc_type": ""})
    rows = R.filtered_chunks(_texts(v), v.filings, date_from=date(1996, 1, 1), date_to=date(2000, 12, 31), **asked)
    return rows.select("chunk_id", "doc_type", "filed_at")


@query(
    "r05_pages",
    duck_sql("SELECT document_id, CAST(chunk_index AS BIGINT) AS chunk_index FROM chunks WHERE page_end >= 2 AND page_start <= 3 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) <= 12", "chunks"),
)
def _(v: DriverViews):
    rows = R.document_pages(v.chunks, first=2, last=3, limit=12)
    return rows.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"))




@query(
    "r07_quality",
    duck_sql(
        """, ans AS (SELECT q.query_id, d.doc_id AS document_id FROM q JOIN benchmark b ON b.item_id = q.query_id JOIN documents d ON contains(d.text, b.text)),
             f AS (SELECT a.query_id, min(t.place) AS first_rank FROM (SELECT DISTINCT query_id FROM ans) a LEFT JOIN (SELECT t.query_id, t.place FROM top t JOIN ans x ON x.query_id = t.query_id AND x.document_id = t.chunk_id) t USING (query_id) GROUP BY 1)
             SELECT count(*) AS questions, count(*) FILTER (first_rank <= 1) AS hit_1, count(*) FILTER (first_rank <= 3) AS hit_3, count(*) FILTER (first_rank <= 8) AS hit_8, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM f""",
        ctes=",".join((_COSINE_DOCS, _WORDS, _FUSED)),
    ),
)
def _(v: DriverViews):
    texts = _texts(v)
    passages = v.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    found = R.documents_holding(texts, passages.join(_questions(v).select("query_id"), "query_id", "left_semi"))
    asked = found.join(passages, "query_id").select("query_id", "document_id", F.concat(F.lit("\\Q"), "passage", F.lit("\\E")).alias("answer"))
    expected = R.expected_pages(texts, asked)
    return R.retrieval_quality(_hybrid(v), expected).withColumn("mrr", F.round("mrr", 6))


@query("r08_approximate")
def _(v: DriverViews):
    return R.approximate_hits(_vectors(v), _questions(v), limit=10)


@query("r09_half_precision")
def _(v: DriverViews):
    return R.half_precision(v.table("embeddings")).select("vec_id", F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",").alias("embedding"))


# --- verification ------------------------------------------------------------------------------------

_FACTS = """facts AS (SELECT estimate_id, document_id, category, tonnes, au, cu, split_part(estimate_id, '-', 2) AS line, domain, reviewed,
    l_returnflag AS flag, l_linestatus AS st FROM (SELECT r.*, x.l_returnflag, x.l_linestatus FROM resources r JOIN
      (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS k, l_returnflag, l_linestatus FROM lineitem) x ON x.k = r.estimate_id))"""


def _facts(v: DriverViews):
    """Resource rows with the flags of every line of their id, as a join of the table with itself gives them, dealt by document.

    An id names its document, so all lines of an id are found where the document is.
    """
    lines = deal("l_orderkey", v.table("lineitem"))[0].withColumn("line_id", F.expr(LINE_ID))
    flags = F.collect_list(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("st"))).over(Window.partitionBy("l_orderkey", "line_id"))
    rows = v.resources_of(lines.withColumn("_flags", flags).select("*", F.inline("_flags")), "flag", "st")
    return rows.withColumnRenamed("estimate_id", "fact_id").withColumn("contained_metal", F.create_map().cast("map<string,double>"))


def _fact_chunks(v: DriverViews, facts=None):
    """One chunk per resource row that prints its figures; rows flagged N print no class word."""
    words = {
        "measured": "Measured", "indicated": "Indicated", "inferred": "Inferred", "measured+indicated": "M & I", "proven": "Proved", "probable": "Probable",
        "2p": "Proven and Probable",
    }
    named = F.lit("?")
    for code, word in words.items():
        named = F.when(F.col("category") == code, F.lit(word)).otherwise(named)
    word = F.when(F.col("flag") == "N", F.lit("Unclassified")).otherwise(named)
    size = F.when(F.col("st") == "F", F.format_number(F.col("tonnes") * F.lit(1e-3), 3)).otherwise(F.format_number("tonnes", 2))
    grade = lambda k, tail: F.coalesce(F.concat(F.lit(" "), F.format_number(F.try_element_at("grade", F.lit(k)), 1), F.lit(tail)), F.lit(""))
    text = F.concat(F.lit("Estimate table\n"), word, F.lit(" material, "), size, F.lit(" at"), grade("Au_gpt", " g/t Au"), grade("Cu_pct", " % Cu"))
    rows = _facts(v) if facts is None else facts
    # an exploded list of one, as filters on the text would make it again
    return rows.select(F.col("fact_id").alias("chunk_id"), "document_id", F.split("fact_id", "-")[1].cast("int").alias("chunk_index"), F.explode(F.array(text)).alias("content"))


_GOOD = "flag <> 'N' AND tonnes > 0 AND coalesce(au, 1) > 0"


@query("v04_verify_resources", duck_sql(f"SELECT estimate_id AS fact_id, {_GOOD} AS verified FROM facts WHERE NOT reviewed", "resources", ctes=_FACTS))
def _(v: DriverViews):
    return V.verify_resources(_facts(v), _fact_chunks(v), dealt=True).select("fact_id", "verified")


@query(
    "v05_verify_drills",
    duck_sql(
        """SELECT drill_id AS fact_id, coalesce(hole_id IS NOT NULL AND length(hole_id) > 3 AND from_m > 0 AND interval_m > 0 AND coalesce(au, cu) IS NOT NULL AND NOT reviewed, false) AS verified FROM drills WHERE NOT reviewed""",
        "drills",
    ),
)
def _(v: DriverViews):
    drills = v.drills.withColumnRenamed("drill_id", "fact_id")
    assay = F.coalesce(F.try_element_at("assays", F.lit("Au_gpt")), F.try_element_at("assays", F.lit("Cu_pct")))
    printed = drills.filter("hole_id IS NOT NULL AND interval_m IS NOT NULL AND NOT reviewed").filter(assay.isNotNull())
    pad = F.repeat(F.lit("."), F.lit(200))
    text = F.concat(
        F.lit("hole "), F.lower("hole_id"), F.lit(": "), F.format_number("interval_m", 1), F.lit(" m from "), F.format_number("from_m", 0), F.lit(" m, "), F.format_number(assay, 2), F.lit(" "), pad
    )
    chunks = printed.select(F.col("fact_id").alias("chunk_id"), "document_id", F.lit(0).alias("chunk_index"), text.alias("content"))
    # Hole ids shorter than three letters and digits prove nothing.
    return V.verify_drills(drills, chunks).select("fact_id", "verified")


@query(
    "v06_verify_economics",
    duck_sql(
        """SELECT study_id AS fact_id, npv_key IS NOT NULL AND study_id % 3 = 0 AS verified FROM economics WHERE NOT reviewed""",
        "economics",
    ),
)
def _(v: DriverViews):
    studies = v.economics.withColumnRenamed("study_id", "fact_id").withColumn("npv", F.map_filter("npv", lambda k, _: k != "unspecified"))
    value = F.try_element_at(F.map_values("npv"), F.lit(1))
    other = F.coalesce(F.concat(F.lit(" IRR "), F.format_number("irr_pct", 1), F.lit("%")), F.concat(F.lit(" capital "), F.format_number("capex_initial", 2)), F.lit(""))
    label = F.when(F.col("fact_id") % 3 == 0, F.lit("After-tax NPV of US$ ")).otherwise(F.lit("Revenue of US$ "))
    text = F.concat(label, F.format_number(value, 3), F.lit(" million."), other)
    chunks = studies.filter(value.isNotNull()).select(F.col("fact_id").alias("chunk_id"), "document_id", F.lit(0).alias("chunk_index"), text.alias("content"))
    return V.verify_economics(studies, chunks).select("fact_id", "verified")


@query(
    "v07_apply_verdicts",
    duck_sql(
        f"""SELECT estimate_id AS fact_id, reviewed OR ({_GOOD}) AS reviewed, CASE WHEN NOT reviewed AND {_GOOD} THEN 'auto_source_match' END AS review_source FROM facts""",
        "resources", ctes=_FACTS,
    ),
)
def _(v: DriverViews):
    facts = _facts(v)
    return V.apply_verdicts(facts, V.verify_resources(facts, _fact_chunks(v), dealt=True)).select("fact_id", "reviewed", "review_source")


@query("v07_counts", duck_sql(f"SELECT 'resource' AS kind, count(*) FILTER ({_GOOD}) AS verified, count(*) FILTER (NOT ({_GOOD})) AS to_read FROM facts WHERE NOT reviewed", "resources", ctes=_FACTS))
def _(v: DriverViews):
    return V.verdict_counts({"resource": V.verify_resources(_facts(v), _fact_chunks(v), dealt=True)})


def _decisions(v: DriverViews):
    picked = v.resources.join(v.table("labels"), F.col("document_id") == F.col("doc_id"))
    action = F.when(F.col("toxic") == 1, F.lit("delete")).when(F.col("quality") == 1, F.lit("approve")).otherwise(F.lit("edit"))
    change = F.create_map(F.lit("tonnes"), F.lit("123.5"), F.lit("category"), F.lit("inferred"), F.lit("grade"), F.lit('{"Au_gpt": 2.5}'))
    odd = F.create_map(F.lit("reviewed"), F.lit("true"))
    fields = F.when((action == "edit") & (F.col("document_id") % 2 == 0), change).when(action == "edit", odd)
    first = picked.select(F.lit("resource").alias("kind"), F.col("estimate_id").alias("id"), action.alias("action"), F.lit("ok").alias("note"), fields.alias("fields"), F.lit(1).alias("seq"))
    # a second, contrary decision on every other filing: it comes too late
    late = first.withColumns({"action": F.when(F.col("action") == "delete", F.lit("approve")).otherwise(F.lit("delete")), "seq": F.lit(2)})
    return late.filter("length(id) % 2 = 0").unionByName(first)


_DECIDED = """decided AS (SELECT r.*, CASE WHEN toxic = 1 THEN 'delete' WHEN quality = 1 THEN 'approve' WHEN quality = 0 THEN 'edit' END AS action FROM resources r LEFT JOIN labels ON doc_id = document_id)"""


@query(
    "v08_decisions",
    duck_sql(
        """SELECT estimate_id AS fact_id, round(CASE WHEN e THEN 123.5 ELSE tonnes END, 2) AS tonnes, CASE WHEN e THEN 'inferred' ELSE category END AS category, CASE WHEN e THEN 2.5 ELSE au END AS au,
                  reviewed OR e OR coalesce(action = 'approve', false) AS reviewed, CASE WHEN NOT reviewed AND (e OR action = 'approve') THEN 'human' END AS review_source
           FROM (SELECT *, coalesce(NOT reviewed AND action = 'edit' AND document_id % 2 = 0, false) AS e FROM decided) WHERE NOT coalesce(action = 'delete' AND NOT reviewed, false)""",
        "resources", ctes=_DECIDED,
    ),
)
def _(v: DriverViews):
    facts = v.resources.withColumnRenamed("estimate_id", "fact_id")
    rows = V.apply_decisions(facts, _decisions(v), "resource")
    return rows.select("fact_id", F.round("tonnes", 2).alias("tonnes"), "category", F.try_element_at("grade", F.lit("Au_gpt")).alias("au"), "reviewed", "review_source")


@query(
    "v08_decision_counts",
    duck_sql("SELECT outcome, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN reviewed THEN 'skipped' WHEN action = 'delete' THEN 'delete' WHEN action = 'edit' THEN 'edit' ELSE 'approve' END AS outcome, count(*) AS n FROM decided WHERE action IS NOT NULL GROUP BY 1 UNION ALL SELECT 'skipped', count(*) FROM decided WHERE action IS NOT NULL AND length(estimate_id) % 2 = 0) GROUP BY 1", "resources", ctes=_DECIDED),
)
def _(v: DriverViews):
    facts = v.resources.select(F.col("estimate_id").alias("fact_id"), F.lit("resource").alias("kind"), "reviewed")
    return V.decision_counts(facts, _decisions(v))


@query(
    "s15_decision_lines",
    duck_sql(
        """SELECT estimate_id AS fact_id, round(CASE WHEN e THEN 123.5 ELSE tonnes END, 2) AS tonnes, CASE WHEN e THEN 'inferred' ELSE category END AS category,
                  reviewed OR e OR coalesce(action = 'approve', false) AS reviewed, CASE WHEN NOT reviewed AND (e OR action = 'approve') THEN 'ok' END AS review_note
           FROM (SELECT *, coalesce(NOT reviewed AND action = 'edit' AND document_id % 2 = 0, false) AS e FROM decided) WHERE NOT coalesce(action = 'delete' AND NOT reviewed, false)""",
        "resources", ctes=_DECIDED,
    ),
)
def _(v: DriverViews):
    """Decisions written as JSON lines, in the order in which they were taken, and read back from the files."""
    folder = f"{scratch(v.spark, 'decisions')}/lines"
    exports.write_to_read(_decisions(v).orderBy("seq", "id").drop("seq"), folder)
    facts = v.resources.withColumnRenamed("estimate_id", "fact_id")
    rows = V.apply_decisions(facts, exports.read_decisions(v.spark, folder), "resource")
    return rows.select("fact_id", F.round("tonnes", 2).alias("tonnes"), "category", "reviewed", "review_note")


@query("v08_bulk_approve", duck_sql("SELECT estimate_id, reviewed OR extraction_confidence >= 0.7 AS reviewed, CASE WHEN NOT reviewed AND extraction_confidence >= 0.7 THEN 'human' END AS review_source FROM resources", "resources"))
def _(v: DriverViews):
    return V.bulk_approve(v.resources).select("estimate_id", "reviewed", "review_source")


@query(
    "v09_low_confidence",
    duck_sql("SELECT document_id FROM resources WHERE NOT reviewed AND extraction_confidence < 0.7 UNION SELECT document_id FROM economics WHERE NOT reviewed AND extraction_confidence < 0.7", "resources", "economics"),
)
def _(v: DriverViews):
    return V.low_confidence_documents(v.resources, v.economics)


@query(
    "v10_queue",
    duck_sql(
        """SELECT kind, fact_id, q.project_id, p.name AS project_name, extraction_confidence, label, coalesce(extraction_confidence, 0) < 0.5 AS attention FROM (
             SELECT * FROM (SELECT 'resource' AS kind, estimate_id AS fact_id, project_id, extraction_confidence, category || ' · ' || CAST(CAST(tonnes AS DOUBLE) AS VARCHAR) || ' t' AS label FROM resources WHERE NOT reviewed ORDER BY extraction_confidence NULLS FIRST, fact_id LIMIT 100)
             UNION ALL SELECT * FROM (SELECT 'economics', CAST(study_id AS VARCHAR) AS fact_id, project_id, extraction_confidence, study_type || ' · IRR ' || coalesce(CAST(irr_pct AS VARCHAR), '—') || '%' FROM economics WHERE NOT reviewed ORDER BY extraction_confidence NULLS FIRST, fact_id LIMIT 100)
             UNION ALL SELECT * FROM (SELECT 'drill', drill_id AS fact_id, project_id, extraction_confidence, coalesce(hole_id, 'hole') || ' · ' || coalesce(CAST(interval_m AS VARCHAR), '—') || ' m' FROM drills WHERE NOT reviewed ORDER BY extraction_confidence NULLS FIRST, fact_id LIMIT 100)) q
           JOIN projects p USING (project_id)""",
        "resources", "economics", "drills", "projects",
    ),
)
def _(v: DriverViews):
    return V.review_queue(v.resources, v.economics, v.drills, v.projects).select("kind", "fact_id", "project_id", "project_name", "extraction_confidence", "label", "attention")


@query("v11_queue_size", duck_sql("SELECT CAST((SELECT count(*) FROM resources WHERE NOT reviewed) + (SELECT count(*) FROM economics WHERE NOT reviewed) + (SELECT count(*) FROM drills WHERE NOT reviewed) AS BIGINT) AS n", "resources", "economics", "drills"))
def _(v: DriverViews):
    return V.review_queue_size(v.resources, v.economics, v.drills)


@query(
    "v12_packets",
    duck_sql(
        """, sized AS (SELECT estimate_id AS chunk_id, document_id, CAST(line AS INT) AS chunk_index FROM facts WHERE tonnes > 0 AND NOT reviewed)
           SELECT chunk_id, document_id FROM sized""",
        "resources", ctes=_FACTS,
    ),
)
def _(v: DriverViews):
    facts = _facts(v).filter("NOT reviewed AND tonnes > 0")
    anchors = facts.select("fact_id", "document_id", V.printed_text("tonnes", (1.0, 1e-3, 1e-6), 2).alias("forms"))
    holes = v.drills.filter("hole_id = 'H-none'").select("document_id", "hole_id")
    return V.review_packets(anchors, holes, _fact_chunks(v, facts), dealt=True, min_digits=2).select("chunk_id", "document_id")


# --- evaluation --------------------------------------------------------------------------------------


def _sides(v: DriverViews):
    """Classes are coarse, and many rows have no tonnes or none at all, so one row often has several partners to choose from."""
    tonnes = F.when(F.length("estimate_id") % 3 != 0, F.col("tonnes"))
    rows = v.resources.select("document_id", F.col("estimate_id").alias("row_id"), F.left("category", F.lit(1)).alias("category"), tonnes.alias("tonnes"), "grade")
    new = rows.withColumn("tonnes", F.when(F.length("row_id") % 2 == 0, F.col("tonnes") * 1.01).otherwise(F.col("tonnes") * 1.1))
    return rows, new


#: Both sides walked in id order: each reference row takes the first candidate left that is close.
_WALK = """ref AS (SELECT document_id, estimate_id AS row_id, left(category, 1) AS category, CASE WHEN length(estimate_id) % 3 <> 0 THEN tonnes END AS tonnes, au, cu FROM resources),
cand AS (SELECT * REPLACE (CAST(tonnes AS DOUBLE) * CASE WHEN length(row_id) % 2 = 0 THEN 1.01::DOUBLE ELSE 1.1::DOUBLE END AS tonnes) FROM ref),
steps AS (SELECT *, row_number() OVER (PARTITION BY document_id, category ORDER BY row_id) AS i FROM ref),
pools AS (SELECT document_id, category, list(struct_pack(id := row_id, t := tonnes) ORDER BY row_id) AS free FROM cand GROUP BY ALL),
walk AS (
  SELECT document_id, category, 0::BIGINT AS i, NULL::VARCHAR AS ref_id, NULL::VARCHAR AS cand_id, free FROM pools
  UNION ALL
  SELECT document_id, category, i, row_id, pick, list_filter(free, lambda x: x.id IS DISTINCT FROM pick) FROM (
    SELECT s.document_id, s.category, s.i, s.row_id, w.free, list_filter(w.free, lambda x: CASE WHEN x.t IS NULL OR s.tonnes IS NULL THEN x.t IS NULL AND s.tonnes IS NULL
             ELSE abs(s.tonnes - x.t) <= 0.02::DOUBLE * greatest(abs(s.tonnes), abs(x.t), 1e-9) END)[1].id AS pick
    FROM walk w JOIN steps s ON s.document_id = w.document_id AND s.category = w.category AND s.i = w.i + 1)),
pairs AS (SELECT document_id, ref_id, cand_id FROM walk WHERE cand_id IS NOT NULL)"""
_AGREE = "CASE WHEN a.{g} IS NOT NULL AND b.{g} IS NOT NULL AND abs(a.{g} - b.{g}) <= 0.02::DOUBLE * greatest(abs(a.{g}), abs(b.{g}), 1e-9) THEN 1 ELSE 0 END"


def _recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query(
    "e01_match",
    _recursive(duck_sql(
        f""", agreed AS (SELECT p.document_id, count(*) AS matched, sum({_AGREE.format(g="au")} + {_AGREE.format(g="cu")}) AS agreeing,
                  sum((a.au IS NOT NULL AND b.au IS NOT NULL)::INT + (a.cu IS NOT NULL AND b.cu IS NOT NULL)::INT) AS shared
             FROM pairs p JOIN ref a ON a.document_id = p.document_id AND a.row_id = p.ref_id JOIN ref b ON b.document_id = p.document_id AND b.row_id = p.cand_id GROUP BY 1)
           SELECT document_id, n AS ref_rows, n AS new_rows, coalesce(matched, 0) AS matched, CAST(coalesce(agreeing, 0) AS BIGINT) AS agreeing, CAST(coalesce(shared, 0) AS BIGINT) AS shared
           FROM (SELECT document_id, count(*) AS n FROM ref GROUP BY 1) LEFT JOIN agreed USING (document_id)""",
        "resources", ctes=_WALK,
    )),
)
def _(v: DriverViews):
    return E.compare_extractions(*_sides(v))


@query(
    "e01_unmatched",
    _recursive(duck_sql(
        "SELECT document_id, row_id FROM cand c WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.document_id = c.document_id AND p.cand_id = c.row_id)",
        "resources", ctes=_WALK,
    )),
)
def _(v: DriverViews):
    reference, candidate = _sides(v)
    return E.unmatched_rows(candidate, E.match_rows(reference, candidate)).select("document_id", "row_id")


@query(
    "e02_overlap",
    """WITH r AS (SELECT DISTINCT l_orderkey AS d, 'h' || l_suppkey % 30 AS n FROM lineitem WHERE l_linestatus = 'F'), n AS (SELECT DISTINCT l_orderkey AS d, 'h' || l_suppkey % 30 AS n FROM lineitem WHERE l_returnflag <> 'A'),
            j AS (SELECT coalesce(r.d, n.d) AS d, r.d IS NOT NULL AS a, n.d IS NOT NULL AS b FROM r FULL JOIN n ON r.d = n.d AND r.n = n.n)
       SELECT d AS document_id, count(*) FILTER (a) AS reference, count(*) FILTER (b) AS new, count(*) FILTER (a AND b) AS overlap FROM j GROUP BY 1""",
)
def _(v: DriverViews):
    named = lambda letter: F.concat(F.lit(letter), (F.col("l_suppkey") % 30).cast("string")).alias("name")
    lines = v.table("lineitem")
    old = lines.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("document_id"), named("H"))
    new = lines.filter("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("document_id"), named("h"))
    return E.set_overlap(old, new)


@query(
    "e03_stratified",
    """WITH s AS (SELECT source, count(*) AS n, 200 // (SELECT count(DISTINCT source) FROM documents) AS share FROM documents GROUP BY 1),
            p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS i FROM documents)
       SELECT doc_id, source FROM p JOIN s USING (source) WHERE i % greatest(1, n // share) = 0 AND i // greatest(1, n // share) < share""",
)
def _(v: DriverViews):
    return E.stratified_pick(v.documents, [F.col("n_chars").desc(), F.col("doc_id").asc()], wanted=200).select("doc_id", "source")


# --- formatting ----------------------------------------------------------------------------------------


@query("f01_numbers", "SELECT p_partkey, format('{:t,}', p_partkey * 1237) AS whole, CAST(p_size AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN '.5' ELSE '' END AS short FROM part".replace("format('{:t,}', p_partkey * 1237)", "format('{:,}', p_partkey * 1237)"))
def _(v: DriverViews):
    half = F.col("p_size") + F.when(F.col("p_size") % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return v.table("part").select("p_partkey", fmt.number(F.col("p_partkey") * 1237).alias("whole"), fmt.number(half).alias("short"))


@query(
    "f02_tonnes",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ' Bt' WHEN 1 THEN p_size || ' Mt' WHEN 2 THEN p_size || ' kt' ELSE p_size || ' t' END AS text FROM part""",
)
def _(v: DriverViews):
    scale = F.element_at(F.array(F.lit(1e9), F.lit(1e6), F.lit(1e3), F.lit(1.0)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return v.table("part").select("p_partkey", fmt.tonnes(F.col("p_size") * scale).alias("text"))


@query(
    "f03_grades",
    duck_sql("SELECT estimate_id, CASE WHEN au IS NULL AND cu IS NULL THEN '—' ELSE concat_ws(', ', CAST(au AS INT) || ' g/t Au', CAST(cu AS INT) || '% Cu') END AS text FROM resources", "resources"),
)
def _(v: DriverViews):
    return v.resources.select("estimate_id", fmt.grade("grade").alias("text"))


@query(
    "f04_money",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'US$' ELSE 'XYZ ' END || CASE WHEN o_custkey >= 1000 THEN rtrim(rtrim(((o_custkey + 5) // 1000)::VARCHAR || '.' || lpad(((o_custkey + 5) // 10 % 100)::VARCHAR, 2, '0'), '0'), '.') || 'B' ELSE o_custkey || 'M' END AS text FROM orders WHERE o_custkey > 0""",
)
def _(v: DriverViews):
    code = F.when(F.col("o_orderkey") % 2 == 0, F.lit("USD")).otherwise(F.lit("XYZ"))
    return v.table("orders").filter("o_custkey > 0").select("o_orderkey", fmt.money("o_custkey", code).alias("text"))


@query("f05_contained", "SELECT p_partkey, p_size || ' Moz Au, ' || p_size || ' Blb Cu' AS text, 'US$' || p_size || '/oz Au' AS price FROM part")
def _(v: DriverViews):
    size = F.col("p_size").cast("double")
    metal = F.create_map(F.lit("Au_oz"), size * 1e6, F.lit("Cu_lb"), size * 1e9)
    return v.table("part").select("p_partkey", fmt.contained(metal).alias("text"), fmt.per_unit(F.create_map(F.lit("Au_usd_per_oz"), size)).alias("price"))


@query(
    "f06_ages",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS iso, strftime(ts, '%b %-d') AS short,
              CASE WHEN m < 60 THEN m || ' min' WHEN round(m / 60.0) < 48 THEN CAST(round(m / 60.0) AS BIGINT) || 'h' ELSE CAST(round(round(m / 60.0) / 24) AS BIGINT) || 'd' END AS age
       FROM (SELECT *, CAST(greatest(0, round((epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 60)) AS BIGINT) AS m FROM events)""",
)
def _(v: DriverViews):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return v.table("events").select("event_id", fmt.iso("ts").alias("iso"), fmt.short_date("ts").alias("short"), fmt.age("ts", now).alias("age"))


@query(
    "f07_labels",
    duck_sql(
        """SELECT document_id, CASE source WHEN 'sedar' THEN 'SEDAR+' WHEN 'edgar' THEN 'EDGAR' ELSE 'Newswire' END AS source_label,
           CASE doc_type WHEN 'ni43101' THEN 'NI 43-101 technical report' WHEN 'sk1300' THEN 'S-K 1300 technical report summary' WHEN 'pea' THEN 'Preliminary economic assessment' WHEN 'pfs' THEN 'Pre-feasibility study'
             WHEN 'fs' THEN 'Feasibility study' WHEN 'press_release' THEN 'Press release' WHEN 'mda' THEN 'MD&A' ELSE 'Financial statements' END AS type_label,
           CASE doc_type WHEN 'pea' THEN 'PEA' WHEN 'pfs' THEN 'PFS' WHEN 'fs' THEN 'Feasibility' WHEN 'press_release' THEN 'Press release' ELSE upper(doc_type[1]) || doc_type[2:] END AS stage_label FROM filings""",
        "filings",
    ),
)
def _(v: DriverViews):
    return v.filings.select(
        "document_id", fmt.source_label("source").alias("source_label"), fmt.doc_type_label("doc_type").alias("type_label"), fmt.stage_label("doc_type").alias("stage_label")
    )


@query("f08_tickers", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '—' ELSE 'S' || s_suppkey || ', TSX:T' || s_suppkey END AS text FROM supplier")
def _(v: DriverViews):
    key = F.col("s_suppkey").cast("string")
    blank = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("S"), key))
    foreign = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("T"), key))
    listings = F.array(F.struct(F.lit("US").alias("exchange"), blank.alias("symbol")), F.struct(F.lit("TSX").alias("exchange"), foreign.alias("symbol")))
    return v.table("supplier").select("s_suppkey", fmt.tickers(listings).alias("text"))


@query(
    "s14_export",
    duck_sql(
        """, lr AS (SELECT * FROM resources QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY effective_date DESC NULLS LAST, extraction_confidence DESC NULLS LAST, estimate_id DESC) = 1),
             le AS (SELECT * FROM economics QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY effective_date DESC NULLS LAST, study_id DESC) = 1)
           SELECT p.name AS project, coalesce(c.name, '') AS company, coalesce(p.country, '') AS country, coalesce(p.stage, '') AS stage, array_to_string(p.commodities, '|') AS commodities, coalesce(lr.category, '') AS category,
                  CASE WHEN lr.au IS NULL AND lr.cu IS NULL THEN '—' ELSE concat_ws(', ', CAST(lr.au AS INT) || ' g/t Au', CAST(lr.cu AS INT) || '% Cu') END AS grade, coalesce(le.study_type, '') AS study
           FROM projects p LEFT JOIN companies c ON c.company_id = p.company_id LEFT JOIN lr ON lr.project_id = p.project_id LEFT JOIN le ON le.project_id = p.project_id
           ORDER BY lr.tonnes DESC NULLS LAST, p.name, p.project_id LIMIT 200""",
        "projects", "companies", "resources", "economics",
    ),
)
def _(v: DriverViews):
    rows = L.screener(v.projects, v.companies, v.resources, v.economics, v.filings)
    return exports.export_columns(rows).select("project", "company", "country", "stage", "commodities", "category", "grade", "study")
