"""Registered text, normalisation and source-parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..functions import normalize as N
from ..functions import text as T
from ..operators import texts as X
from .driver_views import DriverViews, duck_sql
from .registry import query


# --- text ------------------------------------------------------------------------------------------


@query("t01_nul_strip", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(v: DriverViews):
    dirty = F.concat(F.left("text", F.lit(5)), F.lit("\u0000"), F.expr("substring(text, 6)"))
    return v.documents.select("doc_id", F.md5(T.without_nuls(dirty)).alias("digest"))


@query(
    "t02_page_quality",
    duck_sql(
        """, p AS (SELECT document_id, chunk_index AS page, length(trim(content)) < 100 AS low_text, chunk_index % 3 <> 0 AS readable FROM chunks),
              u AS (SELECT *, coalesce(sum(CASE WHEN low_text AND readable THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM p)
              SELECT document_id, page, low_text, low_text AND readable AND used < 2 AS was_ocr, low_text AND NOT (readable AND used < 2) AS ocr_skipped FROM u""",
        "chunks",
    ),
)
def _(v: DriverViews):
    pages = v.chunks.select(
        "document_id", F.col("chunk_index").cast("long").alias("page"), F.col("content").alias("text"),
        F.when(F.col("chunk_index") % 3 != 0, F.lit("read")).alias("ocr_text"),
    )
    return X.page_quality(pages, budget=2).select("document_id", "page", "low_text", "was_ocr", "ocr_skipped")


_BLOCKS = """blocks AS (SELECT document_id, page_start AS page, chunk_index AS position,
    CASE WHEN chunk_index % 5 = 1 THEN 'Item ' || chunk_index || ' Estimate' || chr(10) || content WHEN chunk_index % 7 = 2 THEN '  XI. Mineral ' || chunk_index
         WHEN chunk_index % 11 = 3 THEN chunk_index || '.1 Results' ELSE content END AS text FROM chunks),
heads AS (SELECT *, regexp_extract(trim(text), '^([^\\r\\n]*)', 1) AS line FROM blocks),
found AS (SELECT *, CASE WHEN length(line) BETWEEN 1 AND 120 THEN coalesce(nullif(regexp_extract(line, '(?i)^\\s*(item\\s+\\d+[a-z]?\\b.*)$', 1), ''),
    nullif(regexp_extract(line, '^\\s*((?:[IVXLC]+)[.)]\\s+[A-Z].*)$', 1), ''), nullif(regexp_extract(line, '^\\s*(\\d{1,2}(?:\\.\\d{1,2})*[.)]?\\s+[A-Z].*)$', 1), '')) END AS head FROM heads)"""


def _blocks(v: DriverViews):
    i = F.col("chunk_index")
    number = i.cast("string")
    text = (
        F.when(i % 5 == 1, F.concat(F.lit("Item "), number, F.lit(" Estimate\n"), "content"))
        .when(i % 7 == 2, F.concat(F.lit("  XI. Mineral "), number))
        .when(i % 11 == 3, F.concat(number, F.lit(".1 Results")))
        .otherwise(F.col("content"))
    )
    return v.chunks.select("document_id", F.col("page_start").alias("page"), i.cast("long").alias("position"), text.alias("text"), (i % 9 == 4).alias("is_table"))


@query(
    "t03_headings",
    duck_sql(
        "SELECT document_id, position, last_value(head IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, position ROWS UNBOUNDED PRECEDING) AS section FROM found",
        "chunks", ctes=_BLOCKS,
    ),
)
def _(v: DriverViews):
    return X.with_sections(_blocks(v)).select("document_id", "position", "section")


def chunks_sql(blocks: str, target: int = 3200, overlap: int = 400) -> str:
    """CTEs that pack ``blocks`` (document_id, page, position, text, is_table, section) one by one into ``packed``."""
    strip = lambda x: f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""b AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, position) AS i FROM {blocks}),
walk AS (
  SELECT DISTINCT document_id, 0::BIGINT AS i, '' AS joined, 0::BIGINT AS size, FALSE AS has, NULL::BIGINT AS p0, NULL::BIGINT AS p1, NULL::VARCHAR AS section,
         NULL::VARCHAR AS one, NULL::BIGINT AS one_from, NULL::BIGINT AS one_to, NULL::VARCHAR AS two, NULL::BIGINT AS page FROM b
  UNION ALL
  SELECT document_id, i + 1, CASE WHEN h2 THEN j2 || chr(10) || chr(10) || text ELSE text END, l2 + length(text), TRUE,
         CASE WHEN f1 THEN page ELSE coalesce(p0, page) END, page, section,
         CASE WHEN f1 AND c1 <> '' THEN c1 END, p0, p1, CASE WHEN f2 AND c2 <> '' THEN c2 END, page
  FROM (
    SELECT *, CASE WHEN f2 THEN right(c2, {overlap}) ELSE j1 END AS j2, CASE WHEN f2 THEN c2 <> '' ELSE h1 END AS h2,
           CASE WHEN f2 THEN length(right(c2, {overlap})) ELSE l1 END AS l2
    FROM (
      SELECT *, f1 AND h1 AND ends = 2 AS f2, {strip("j1")} AS c2
      FROM (
        SELECT *, CASE WHEN f1 THEN right(c1, {overlap}) ELSE joined END AS j1, CASE WHEN f1 THEN c1 <> '' ELSE has END AS h1,
               CASE WHEN f1 THEN length(right(c1, {overlap})) ELSE size END AS l1
        FROM (
          SELECT *, has AND ends > 0 AS f1, {strip("joined")} AS c1
          FROM (
            SELECT w.document_id, w.i, w.joined, w.size, w.has, w.p0, w.p1, b.page::BIGINT AS page, coalesce(b.text, '') AS text, b.section,
                   CASE WHEN w.size + length(coalesce(b.text, '')) <= {target} THEN 0 WHEN b.is_table AND length(b.text) > {target} THEN 2 ELSE 1 END AS ends
            FROM walk w JOIN b ON b.document_id = w.document_id AND b.i = w.i + 1))))) AS x
),
ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY i DESC) = 1),
out AS (
  SELECT document_id, i, 1 AS step, one_from AS a, one_to AS z, one AS content, section FROM walk WHERE one IS NOT NULL
  UNION ALL SELECT document_id, i, 2, page, page, two, section FROM walk WHERE two IS NOT NULL
  UNION ALL SELECT document_id, i, 3, p0, p1, {strip("joined")}, section FROM ends WHERE {strip("joined")} <> ''
),
packed AS (
  SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY i, step) - 1)::INTEGER AS chunk_index,
         coalesce(nullif(a, 0), 1)::INTEGER AS page_start, coalesce(nullif(z, 0), nullif(a, 0), 1)::INTEGER AS page_end, content, section AS section_title FROM out
)"""


_SECTIONS = """sections AS (SELECT f.document_id, f.page, f.position, f.text, f.position % 9 = 4 AS is_table,
    last_value(f.head IGNORE NULLS) OVER (PARTITION BY f.document_id ORDER BY f.page, f.position ROWS UNBOUNDED PRECEDING) AS section FROM found f)"""


@query("t04_chunks", duck_sql("SELECT * FROM packed", "chunks", ctes=f"{_BLOCKS},\n{_SECTIONS},\n{chunks_sql('sections')}").replace("WITH ", "WITH RECURSIVE ", 1))
def _(v: DriverViews):
    return X.chunk_blocks(_blocks(v))


@query(
    "t05_table_block",
    "SELECT doc_id, md5(lang || chr(9) || source || chr(10) || chr(9) || CAST(n_chars AS VARCHAR)) AS digest FROM documents",
)
def _(v: DriverViews):
    rows = F.array(F.array(F.concat(F.lit(" "), "lang"), F.col("source")), F.array(F.lit(""), F.lit(None)), F.array(F.lit(None).cast("string"), F.col("n_chars").cast("string")))
    return v.documents.select("doc_id", F.md5(T.table_block(rows)).alias("digest"))


_HINTS = ("tion", "ungen")
_SELECT = """hits AS (SELECT *, regexp_matches(' ' || left(lower(content), 500), 'tion|ungen') AS near FROM chunks WHERE regexp_matches(lower(content), 'tion|ungen')),
best AS (SELECT document_id, bool_or(near) AS any_near FROM hits GROUP BY 1),
runs AS (SELECT h.*, sum(length(content)) OVER w AS run, row_number() OVER w AS nth FROM hits h JOIN best USING (document_id) WHERE near OR NOT any_near
         WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING)),
chosen AS (SELECT * FROM runs WHERE run <= 1500 OR nth = 1)"""


def _selected(v: DriverViews):
    return X.select_chunks(v.chunks.withColumn("section_title", F.lit(None).cast("string")), _HINTS, budget=1500)


@query("t06_select", duck_sql("SELECT document_id, CAST(chunk_index AS BIGINT) AS chunk_index FROM chosen", "chunks", ctes=_SELECT))
def _(v: DriverViews):
    return _selected(v).select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"))


@query(
    "t07_first_pages",
    duck_sql(
        """, c AS (SELECT *, page_end + document_id % 3 AS pe FROM chunks), h AS (SELECT document_id, bool_or(pe <= 1) AS has FROM c GROUP BY 1)
           SELECT document_id, CAST(chunk_index AS BIGINT) AS chunk_index FROM c JOIN h USING (document_id) QUALIFY CASE WHEN has THEN pe <= 1 ELSE row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) <= 3 END""",
        "chunks",
    ),
)
def _(v: DriverViews):
    shifted = v.chunks.withColumn("page_end", (F.col("page_end") + F.col("document_id") % 3).cast("int"))
    return X.first_pages(shifted, 1).select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"))


@query(
    "t08_context",
    duck_sql(
        """SELECT document_id, count(*) AS chunks, md5(string_agg('[p.' || page_start || '-' || page_end || ' | ]' || chr(10) || content, chr(10) || chr(10) ORDER BY chunk_index)) AS digest
           FROM chosen GROUP BY 1""",
        "chunks", ctes=_SELECT,
    ),
)
def _(v: DriverViews):
    return X.assembled_context(_selected(v)).select("document_id", "chunks", F.md5("context").alias("digest"))


_BATCHES = """b AS (SELECT document_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(greatest(1, length(content) // 4) AS BIGINT) AS tokens,
    row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS i FROM chunks),
walk AS (
  SELECT document_id, i, chunk_index, tokens, 0 AS batch_no, 1 AS texts, tokens AS used FROM b WHERE i = 1
  UNION ALL
  SELECT document_id, i, chunk_index, tokens, CASE WHEN fits THEN batch_no ELSE batch_no + 1 END, CASE WHEN fits THEN texts + 1 ELSE 1 END,
         CASE WHEN fits THEN used + tokens ELSE tokens END
  FROM (SELECT b.*, w.batch_no, w.texts, w.used, w.texts < 8 AND w.used + b.tokens <= 400 AS fits FROM walk w JOIN b ON b.document_id = w.document_id AND b.i = w.i + 1) AS x
)"""


@query("t09_batches", duck_sql("SELECT document_id, chunk_index, tokens, batch_no FROM walk", "chunks", ctes=_BATCHES).replace("WITH ", "WITH RECURSIVE ", 1))
def _(v: DriverViews):
    return X.embedding_batches(v.chunks, max_texts=8, max_tokens=400)


@query("t09_token_estimate", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
def _(v: DriverViews):
    return v.documents.select("doc_id", T.estimated_tokens("text").alias("tokens"))


@query(
    "t11_cell_numbers",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey * 1000 + p_size AS DOUBLE) WHEN 1 THEN -p_retailprice WHEN 2 THEN NULL ELSE p_retailprice END AS value FROM part""",
)
def _(v: DriverViews):
    k = F.col("p_partkey")
    printed = (
        F.when(k % 4 == 0, F.concat(F.format_number(k * 1000 + F.col("p_size"), 0), F.lit(" t")))
        .when(k % 4 == 1, F.concat(F.lit("("), F.col("p_retailprice").cast("string"), F.lit(")")))
        .when(k % 4 == 2, F.lit("—"))
        .otherwise(F.concat(F.lit("US$ "), F.col("p_retailprice").cast("string")))
    )
    return v.table("part").select("p_partkey", T.cell_number(printed).alias("value"))


_HEADERS = ("grade cu %", "au (g/t)", "ag", "u3o8 ppm", "mo", "sio2 pct", "pb oz/t", "name")
_KEYS = ("Cu_pct", "Au_gpt", "Ag_gpt", "U3O8_ppm", "Mo_pct", "SiO2_pct", "Pb_opt", None)


@query("t13_grade_keys", "SELECT p_partkey, " + str(list(_KEYS)).replace("None", "NULL") + "[CAST(p_partkey % 8 + 1 AS INT)] AS grade_key FROM part")
def _(v: DriverViews):
    header = F.element_at(F.array(*[F.lit(h) for h in _HEADERS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return v.table("part").select("p_partkey", T.header_grade_key(header).alias("grade_key"))


@query(
    "t16_title_ids",
    """SELECT s_suppkey, 'Acme ' || s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'TK' || s_suppkey END AS ticker, CASE WHEN s_suppkey % 3 = 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS cik,
              CASE WHEN s_suppkey % 3 = 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 10, '0') ELSE lpad(CAST(s_nationkey AS VARCHAR), 10, '0') END AS found_cik FROM supplier""",
)
def _(v: DriverViews):
    key = F.col("s_suppkey")
    number = key.cast("string")
    title = F.concat(
        F.lit("Acme "), "s_name", F.when(key % 2 == 0, F.concat(F.lit("  (TK"), number, F.lit(")"))).otherwise(F.lit("")),
        F.when(key % 3 == 0, F.concat(F.lit(" (CIK 000"), number, F.lit(")"))).otherwise(F.lit("")),
    )
    rows = v.table("supplier").select("s_suppkey", title.alias("title"), F.concat(F.lit("edgar/"), "s_nationkey", F.lit("/a.pdf")).alias("path"))
    return rows.select("s_suppkey", T.title_identity("title").alias("i"), T.document_cik("title", "path").alias("found_cik")).select("s_suppkey", "i.*", "found_cik")


@query(
    "t17_event_class",
    """SELECT doc_id, CASE WHEN lang IN ('fr','es') AND regexp_matches(t, 'drill|intercept|assay|metre of|meter of|m of') THEN 'drill_results'
              WHEN lang IN ('fr','es') AND regexp_matches(t, 'financ|bought deal|private placement|offering|bought-deal|placement') THEN 'financing' ELSE 'new_report' END AS event_type
       FROM (SELECT *, lower(source || ' ' || CASE WHEN doc_id % 4 = 0 THEN 'Bought Deal ' WHEN doc_id % 4 = 1 THEN '12 m of gold ' ELSE '' END || text) AS t FROM documents)""",
)
def _(v: DriverViews):
    kind = F.when(F.col("lang") == "fr", F.lit("mda")).when(F.col("lang") == "es", F.lit("Press_Release")).otherwise(F.col("lang"))
    lead = F.when(F.col("doc_id") % 4 == 0, F.lit("Bought Deal ")).when(F.col("doc_id") % 4 == 1, F.lit("12 m of gold ")).otherwise(F.lit(""))
    return v.documents.select("doc_id", T.event_type(kind, "source", F.concat(lead, "text")).alias("event_type"))


_MARKS = """marks AS (SELECT DISTINCT source, document_id, sha256(left(content, 500)) AS mark FROM chunks WHERE content <> ''),
sizes AS (SELECT source, document_id, count(*) AS n FROM marks GROUP BY ALL),
common AS (SELECT a.source, a.document_id AS x, b.document_id AS y, count(*) AS c FROM marks a JOIN marks b ON a.source = b.source AND a.mark = b.mark AND a.document_id < b.document_id GROUP BY ALL),
sim AS (SELECT c.source, x, y, c / (sx.n + sy.n - c) AS jaccard FROM common c JOIN sizes sx ON sx.document_id = x JOIN sizes sy ON sy.document_id = y WHERE c / (sx.n + sy.n - c) >= 0.6),
facts AS (SELECT doc_id AS document_id FROM labels)"""


@query(
    "t18_near_duplicate_flags",
    duck_sql(
        """SELECT s.source, s.document_id, EXISTS (SELECT 1 FROM sim WHERE (x = s.document_id AND y IN (SELECT document_id FROM facts)) OR (y = s.document_id AND x IN (SELECT document_id FROM facts))) AS near_duplicate
           FROM sizes s""",
        "chunks", ctes=_MARKS,
    ),
)
def _(v: DriverViews):
    known = v.table("labels").select(F.col("doc_id").alias("document_id"))
    return X.near_duplicate_flags(v.chunks, "source", known=known)


_SENTENCES = "sentences AS (SELECT doc_id AS document_id, lang AS source, unnest(string_split(text, '. ')) AS content FROM documents),\n"


@query(
    "t18_jaccard",
    duck_sql(
        """, heads AS (SELECT source, min(document_id) AS d FROM (SELECT source, document_id, string_agg(mark, '' ORDER BY mark) AS k FROM marks GROUP BY ALL) GROUP BY source, k)
           SELECT sim.source AS lang, x AS left_id, y AS right_id, round(jaccard, 6) AS jaccard FROM sim JOIN heads a ON a.d = x JOIN heads b ON b.d = y WHERE jaccard < 1""",
        ctes=_SENTENCES + _MARKS.replace("FROM chunks", "FROM sentences"),
    ),
)
def _(v: DriverViews):
    sentences = v.documents.select(F.col("doc_id").alias("document_id"), "lang", F.explode(F.split("text", r"\. ")).alias("content"))
    return X.near_duplicates(sentences, "lang").withColumn("jaccard", F.round("jaccard", 6))


_UUID_SQL = "substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || substr(md5({0}), 13, 4) || '-' || substr(md5({0}), 17, 4) || '-' || substr(md5({0}), 21, 12)"


def _cited_messages(v: DriverViews):
    digest = F.md5((F.col("conv_id") % 10).cast("string"))
    cut = lambda a, n: F.substring(digest, a, n)
    uuid = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    page = (F.col("turn") % 3 + 1).cast("string")
    text = F.concat(
        F.col("text"), F.lit(" ["), uuid, F.lit(" p."), page, F.lit("] and ["), F.upper(uuid), F.lit(" p.2-"), (F.col("turn") % 3 + 2).cast("string"), F.lit("] ["), uuid, F.lit(" p."), page, F.lit("]"),
    )
    return v.table("conversations").withColumn("text", text)


_CITES = f"""c AS (SELECT conv_id, turn, {_UUID_SQL.format("CAST(conv_id % 10 AS VARCHAR)")} AS u FROM conversations),
raw AS (SELECT conv_id, turn, 0 AS pos, u AS document_id, CAST(turn % 3 + 1 AS INT) AS a, CAST(turn % 3 + 1 AS INT) AS b FROM c
        UNION ALL SELECT conv_id, turn, 1, upper(u), 2, CAST(turn % 3 + 2 AS INT) FROM c),
labelled AS (SELECT *, '[' || substr(document_id, 1, 8) || ' p.' || CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END || ']' AS label FROM raw)"""


@query(
    "t19_citations",
    duck_sql(
        """SELECT conv_id, turn, label, document_id, a AS page_start, b AS page_end, '/documents/' || document_id || '?page=' || a AS href FROM labelled
           QUALIFY row_number() OVER (PARTITION BY conv_id, label ORDER BY turn, pos) = 1""",
        ctes=_CITES,
    ),
)
def _(v: DriverViews):
    return X.inline_citations(_cited_messages(v)).select("conv_id", "turn", "label", "document_id", "page_start", "page_end", "href")


@query(
    "t20_toc",
    duck_sql(
        """SELECT document_id, CAST(chunk_index AS BIGINT) AS chunk_index, (n + CASE WHEN regexp_matches(content, '(\\.{4,}|(\\. ){4,})\\s*\\d{1,4}') THEN 1 ELSE 0 END) * 3 > n + 2 AS is_toc
           FROM (SELECT *, chunk_index % 4 AS n FROM chunks WHERE content <> '')""",
        "chunks",
    ),
)
def _(v: DriverViews):
    n = (F.col("chunk_index") % 4).cast("int")
    text = F.concat(F.repeat(F.lit("Summary ........ 12\n"), n), F.lit("plain line\n"), "content")
    return v.chunks.filter("content <> ''").select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), T.is_contents_page(text).alias("is_toc"))


@query(
    "t21_titles",
    """SELECT conv_id, CASE WHEN t = '' THEN 'New chat' WHEN length(t) > 80 THEN left(t, 79) || '…' ELSE t END AS title
       FROM (SELECT conv_id, regexp_replace(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), '^\\s+|\\s+$', '', 'g') AS t FROM conversations GROUP BY 1)""",
)
def _(v: DriverViews):
    return X.chat_titles(v.table("conversations"))


@query(
    "t22_extra_citations",
    duck_sql(
        """SELECT conv_id, turn, list_has_any([want], []) AS none, CASE WHEN turn % 2 = 0 THEN '' ELSE '[deadbeef p.9]' END AS extra FROM (SELECT conv_id, turn, label AS want FROM labelled WHERE pos = 0)""",
        ctes=_CITES,
    ),
)
def _(v: DriverViews):
    rows = _cited_messages(v)
    own = T.citation_labels("text")
    cited = F.concat(own, F.when(F.col("turn") % 2 == 1, F.array(F.lit("[deadbeef p.9]"))).otherwise(F.array().cast("array<string>")))
    return X.citations_not_inline(rows.withColumn("cited", cited)).select("conv_id", "turn", F.lit(False).alias("none"), F.array_join("extra", "|").alias("extra"))


@query(
    "q39_chats",
    """SELECT c.conv_id, count(*) FILTER (role IN ('user','assistant')) AS n_messages, max(turn) FILTER (role IN ('user','assistant')) AS last_turn FROM conversations c GROUP BY 1 HAVING count(*) FILTER (role IN ('user','assistant')) > 0""",
)
def _(v: DriverViews):
    from ..operators.listing import chat_list

    return chat_list(v.table("conversations")).select("conv_id", "n_messages", "last_turn")


@query("q39_messages", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations WHERE role IN ('user','assistant')")
def _(v: DriverViews):
    from ..operators.listing import chat_messages

    return chat_messages(v.table("conversations")).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


# --- normalisation ---------------------------------------------------------------------------------

_RAW_COMMODITY = ("Gold", " copper ", "Iron Ore", "Rb", "Rare Earths", "limestone aggregate", "--", "sand")
_COMMODITY = ("Au", "Cu", "Fe", "Rb", "REE", "limestone ag", None, "sand")
_RAW_STAGE = ("Pre-Feasibility", "PRODUCER", "care & maintenance", "unknown", "Early stage")
_STAGE = ("pfs", "production", "care_maintenance", None, "grassroots")
_RAW_COUNTRY = ("U.S.A.", " canada", "Ghana ", "Brazil", "mx")
_COUNTRY = ("United States", "Canada", "Ghana", "Brazil", "Mexico")
_RAW_STUDY = ("Preliminary Economic Assessment", "Scoping", "Bankable", "memo", "FS")
_STUDY = ("pea", "scoping", "fs", "other", "fs")
_RAW_STANDARD = ("NI 43-101", "S-K 1300", "JORC", "CIM", "43-101")
_STANDARD = ("NI43-101", "SK-1300", "JORC", None, "NI43-101")


def _sql_list(values) -> str:
    return "[" + ",".join("NULL" if x is None else "'" + x + "'" for x in values) + "]"


def _pick(values, key: str):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.col(key) % len(values) + 1).cast("int"))


@query(
    "n01_vocabularies",
    f"""SELECT p_partkey, {_sql_list(_COMMODITY)}[CAST(p_partkey % 8 + 1 AS INT)] AS commodity, {_sql_list(_STAGE)}[CAST(p_partkey % 5 + 1 AS INT)] AS stage, {_sql_list(_COUNTRY)}[CAST(p_partkey % 5 + 1 AS INT)] AS country,
        {_sql_list(_STUDY)}[CAST(p_partkey % 5 + 1 AS INT)] AS study, {_sql_list(_STANDARD)}[CAST(p_partkey % 5 + 1 AS INT)] AS standard FROM part""",
)
def _(v: DriverViews):
    k = "p_partkey"
    return v.table("part").select(
        k, N.commodity(_pick(_RAW_COMMODITY, k)).alias("commodity"), N.stage(_pick(_RAW_STAGE, k)).alias("stage"), N.country(_pick(_RAW_COUNTRY, k)).alias("country"),
        N.study_type(_pick(_RAW_STUDY, k)).alias("study"), N.standard(_pick(_RAW_STANDARD, k)).alias("standard"),
    )


@query("n02_commodity_arrays", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Au|Cu' ELSE 'Cu|p' || p_size || '' END AS commodities FROM part")
def _(v: DriverViews):
    even = F.array(F.lit("gold"), F.lit("  "), F.lit("Au"), F.lit("copper"))
    odd = F.array(F.lit("Copper"), F.lit("cu"), F.concat(F.lit("p"), F.col("p_size").cast("string")))
    values = F.when(F.col("p_size") % 2 == 0, even).otherwise(odd)
    return v.table("part").select("p_partkey", F.array_join(N.commodities(values), "|").alias("commodities"))


@query(
    "n07_project_keys",
    """SELECT p_partkey, p_name || ' ' || p_size AS key, p_size % 2 = 0 AS same FROM part""",
)
def _(v: DriverViews):
    name = F.concat(F.lit("The "), F.upper("p_name"), F.lit("-"), F.col("p_size").cast("string"), F.lit(" Mine, Inc."))
    company = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" Corp"))).otherwise(F.lit("Other Ltd"))
    return v.table("part").select("p_partkey", N.project_key(name).alias("key"), N.named_like_company(name, company).alias("same"))


@query("n09_cik_dates", "SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS cik, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def _(v: DriverViews):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("Q3 2001")).otherwise(F.concat(F.lit(" "), day, F.lit("T10:00:00Z")))
    return v.table("orders").select("o_orderkey", N.cik(F.concat(F.lit("CIK-"), F.col("o_orderkey").cast("string"))).alias("cik"), N.iso_date(text).alias("day"))


_LABELS = (
    "Indicated - Upper Zone (exclusive of reserves)", "Measured & Indicated", "Total Inferred Mineral Resources", "P+P reserves", "historic estimate",
    "M+I (inclusive)", "Proved and Probable - North", "Inferred (open pit)",
)
_LABEL_BASE = ("indicated", "measured+indicated", "inferred", "2p", "historic estimate", "measured+indicated", "2p", "inferred")
_LABEL_DOMAIN = ("upper zone (exclusive of reserves)", None, None, None, None, "inclusive", "north", "open pit")


@query(
    "n10_category_split",
    f"SELECT l_orderkey, l_linenumber, l_partkey, {_sql_list(_LABEL_BASE)}[CAST(l_partkey % 8 + 1 AS INT)] AS category, {_sql_list(_LABEL_DOMAIN)}[CAST(l_partkey % 8 + 1 AS INT)] AS domain FROM lineitem",
)
def _(v: DriverViews):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.split_category(_pick(_LABELS, "l_partkey")).alias("s")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "s.*"
    )


_RAW = """raw AS (SELECT estimate_id, document_id, category, tonnes, CASE hash_no % 4 WHEN 0 THEN 't' WHEN 1 THEN 'kt' WHEN 2 THEN 'short_t' ELSE 'boxes' END AS unit, au, cu, hash_no FROM
  (SELECT *, CAST(split_part(estimate_id, '-', 3) AS BIGINT) AS hash_no FROM resources)),
metric AS (SELECT *, tonnes * CASE unit WHEN 'kt' THEN 1000 WHEN 'short_t' THEN 0.90718474 ELSE 1 END AS mt, CASE WHEN hash_no % 5 = 0 THEN au * 1000 ELSE au END AS gold, CASE WHEN hash_no % 7 = 0 THEN cu * 20 ELSE cu END AS copper FROM raw),
checked AS (SELECT *, least(0.9, CASE WHEN unit = 'boxes' THEN 0.3 END, CASE WHEN mt <= 0 THEN 0.3 WHEN mt < 10000 THEN 0.5 END, CASE WHEN category = 'proven' AND hash_no % 3 = 0 THEN 0.3 END,
    CASE WHEN hash_no % 11 = 0 THEN 0.4 END, CASE WHEN gold >= 5000 THEN 0.5 END, CASE WHEN copper > 100 THEN 0.3 END) AS confidence FROM metric)"""


def _raw_resources(v: DriverViews):
    rows = v.resources.withColumn("k", F.split("estimate_id", "-")[2].cast("long"))
    k = F.col("k")
    gold, copper = F.try_element_at("grade", F.lit("Au_gpt")), F.try_element_at("grade", F.lit("Cu_pct"))
    entry = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value")))
    grade = F.map_from_entries(
        F.array_compact(
            F.array(
                entry("Au_gpt", F.when(k % 5 == 0, gold * 1000).otherwise(gold)), entry("Cu_pct", F.when(k % 7 == 0, copper * 20).otherwise(copper)),
                entry("bad key", F.when(k % 11 == 0, F.lit(1.0))),
            )
        )
    )
    return rows.select(
        "estimate_id", "document_id",
        F.when((F.col("category") == "proven") & (k % 3 == 0), F.lit("historic estimate")).otherwise(F.col("category")).alias("category"),
        F.lit(None).cast("string").alias("domain"), "tonnes", _pick(("t", "kt", "short_t", "boxes"), "k").alias("tonnage_unit"), grade.alias("grade"),
        F.create_map(F.lit("Ag_oz"), F.lit(5.0), F.lit("Cu"), F.lit(1.0)).alias("contained_metal"), F.lit(0.9).alias("extraction_confidence"),
    )


@query(
    "n12_confidence",
    duck_sql("SELECT estimate_id, round(mt, 4) AS tonnes, CAST(confidence AS DOUBLE) AS extraction_confidence FROM checked", "resources", ctes=_RAW),
)
def _(v: DriverViews):
    return N.validate_resources(_raw_resources(v)).select("estimate_id", F.round("tonnes", 4).alias("tonnes"), "extraction_confidence")


@query(
    "n13_moved_ounces",
    duck_sql(
        "SELECT estimate_id, CASE WHEN gold < 5000 THEN gold END AS gold_grade, copper AS copper_grade, CASE WHEN gold >= 5000 THEN gold END AS gold_oz, 5.0::DOUBLE AS silver_oz FROM checked",
        "resources", ctes=_RAW,
    ),
)
def _(v: DriverViews):
    get = lambda m, k, n: F.try_element_at(m, F.lit(k)).alias(n)
    return N.validate_resources(_raw_resources(v)).select(
        "estimate_id", get("grade", "Au_gpt", "gold_grade"), get("grade", "Cu_pct", "copper_grade"), get("contained_metal", "Au_oz", "gold_oz"), get("contained_metal", "Ag_oz", "silver_oz")
    )


@query(
    "n14_money",
    duck_sql(
        """SELECT study_id, round(CASE WHEN cap >= 1000000 THEN cap / 1000000 ELSE cap END, 6) AS capex_initial, npv AS npv_5, currency,
             CAST(least(0.9, CASE WHEN irr > 500 THEN 0.3 END, CASE WHEN cap >= 1000000 THEN 0.6 WHEN cap >= 100000 THEN 0.3 END, CASE WHEN bad THEN 0.4 END, CASE WHEN npv_raw >= 1000000 THEN 0.6 WHEN npv_raw >= 100000 THEN 0.3 END) AS DOUBLE) AS extraction_confidence
           FROM (SELECT *, CASE WHEN npv_raw >= 1000000 THEN npv_raw / 1000000 ELSE npv_raw END AS npv FROM
             (SELECT o_orderkey AS study_id, o_totalprice * CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 0.01 END AS cap, CAST(o_custkey % 700 AS DOUBLE) AS irr, o_custkey % 5 = 0 AS bad,
                     CAST(o_custkey * 2000 AS DOUBLE) AS npv_raw, CASE WHEN o_custkey % 2 = 0 THEN 'USD' END AS currency FROM orders))"""
    ),
)
def _(v: DriverViews):
    key = F.col("o_custkey")
    factor = F.when(key % 3 == 0, F.lit(1.0)).when(key % 3 == 1, F.lit(100.0)).otherwise(F.lit(0.01))
    npv = F.map_from_entries(
        F.array_compact(
            F.array(
                F.struct(F.lit("post_tax_5pct").alias("key"), (key * 2000).cast("double").alias("value")),
                F.when(key % 5 == 0, F.struct(F.lit("unspecified").alias("key"), F.lit(1.0).alias("value"))),
            )
        )
    )
    rows = v.table("orders").select(
        F.col("o_orderkey").alias("study_id"), F.lit("PFS").alias("study_type"), F.when(key % 2 == 0, F.lit(" usd ")).otherwise(F.lit("dollars")).alias("currency"), npv.alias("npv"),
        (key % 700).cast("double").alias("irr_pct"), (F.col("o_totalprice") * factor).alias("capex_initial"), F.lit(9.0).alias("mine_life_years"), F.lit(0.9).alias("extraction_confidence"),
    )
    out = N.validate_economics(rows)
    return out.select("study_id", F.round("capex_initial", 6).alias("capex_initial"), F.try_element_at("npv", F.lit("post_tax_5pct")).alias("npv_5"), "currency", "extraction_confidence")


@query(
    "n15_intervals",
    duck_sql(
        "SELECT drill_id, coalesce(interval_m, abs(t - from_m)) AS interval_m, CAST(least(extraction_confidence, CASE WHEN t < from_m THEN 0.3 END) AS DOUBLE) AS extraction_confidence FROM (SELECT *, to_m - 60 AS t FROM drills)",
        "drills",
    ),
)
def _(v: DriverViews):
    return N.validate_drills(v.drills.withColumn("to_m", F.col("to_m") - 60)).select("drill_id", "interval_m", "extraction_confidence")


@query(
    "n17_salvage",
    duck_sql(
        """SELECT event_id, CASE WHEN k % 7 = 0 THEN 'dropped' WHEN k % 5 = 0 THEN 'salvaged' ELSE 'kept' END AS salvage, CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k * 10 AS DOUBLE) END AS tonnes,
                  CASE WHEN k % 5 = 0 THEN 0.3::DOUBLE WHEN k % 3 = 0 THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS extraction_confidence
           FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
    ),
)
def _(v: DriverViews):
    k = F.get_json_object("props", "$.k").cast("long")
    tonnes = F.when(k % 7 == 0, F.lit('"many"')).otherwise((k * 10).cast("string"))
    confidence = F.when(k % 5 == 0, F.lit('"sure"')).when(k % 3 == 0, F.lit("null")).otherwise(F.lit("0.9"))
    payload = F.concat(F.lit('{"rows":[{"category":"inferred","tonnes":'), tonnes, F.lit(',"grade":{"Au_gpt":1.5},"extraction_confidence":'), confidence, F.lit("}]}"))
    rows = N.salvage_resource_rows(v.table("events").select("event_id", payload.alias("payload")))
    return rows.select("event_id", "salvage", "tonnes", "extraction_confidence")


@query(
    "n18_trusted",
    duck_sql("SELECT estimate_id, document_id FROM resources QUALIFY min(extraction_confidence) OVER (PARTITION BY document_id) >= 0.7", "resources"),
)
def _(v: DriverViews):
    return N.trusted_documents(v.resources).select("estimate_id", "document_id")


