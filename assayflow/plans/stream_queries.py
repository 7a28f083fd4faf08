"""Registered streaming queries: driver tables streamed as files, run until nothing is left."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..streaming import jobs as K
from ..streaming import state as S
from .driver_views import DriverViews, duck_sql
from .monitor_queries import _PENDING, _WATCH_VIEWS, _WATCHED, _alerts
from .registry import query
from .text_queries import chunks_sql


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/streams/{name}-{uuid.uuid4().hex}"


@query(
    "k01_landing",
    """SELECT doc_id, source FROM (SELECT doc_id, source, sha256(text) AS h FROM documents) QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id % 3, doc_id) = 1""",
)
def _(v: DriverViews):
    """Documents come in three deliveries, the last with all earlier ones over again and with the oldest times."""
    folder = scratch(v.spark, "landing")
    filings = v.documents.select(
        "source", F.col("doc_id").cast("string").alias("external_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "doc_id",
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") - 10_000_000 * (F.col("doc_id") % 3)).alias("seen_at"),
    )
    for kept in ("doc_id % 3 = 0", "doc_id % 3 = 1", "true"):
        filings.filter(kept).write.mode("append").parquet(f"{folder}/in")
        arriving = v.spark.readStream.schema(filings.schema).parquet(f"{folder}/in")
        K.run_available(*K.landing_job(arriving, f"{folder}/store"), f"{folder}/checkpoint")
    return K.read_batches(v.spark, f"{folder}/store", K.LANDED).select("doc_id", "source")


@query("k02_alert_deliveries", duck_sql("SELECT alert_id, count(*) AS n FROM (SELECT DISTINCT a.alert_id, f.event_id FROM feed f JOIN alerts a USING (user_id) WHERE a.channel = 'email' AND a.address IS NOT NULL AND a.address <> '') GROUP BY 1", *_WATCH_VIEWS, ctes=_PENDING))
def _(v: DriverViews):
    folder = scratch(v.spark, "alerts")
    events = K.file_stream(v.spark, v.folder, "events.parquet").selectExpr("event_id", "user_id AS project_id", "event_type", "cast(ts AS date) AS event_date", "cast(ts AS timestamp) AS created_at")
    stream, notify = K.notice_job(events, _alerts(v), v.watchlist_items, v.watchlists, v.projects, f"{folder}/store")
    K.run_available(stream, notify, f"{folder}/checkpoint")
    return K.delivery_counts(v.spark, f"{folder}/store")


def _counts(v: DriverViews, name: str, frame, schema: str, keys: list[str]):
    folder = scratch(v.spark, name)
    K.run_available(frame, K.update_job(f"{folder}/store"), f"{folder}/checkpoint", mode="update")
    return K.latest_rows(v.spark, f"{folder}/store", schema, keys)


@query(
    "k03_freshness",
    """SELECT CAST(date_trunc('hour', ts) - to_hours(CAST(h AS INT)) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events, (SELECT unnest(range(0, 24)) AS h) GROUP BY ALL""",
)
def _(v: DriverViews):
    events = K.file_stream(v.spark, v.folder, "events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows = _counts(v, "freshness", K.sliding_counts(events, "ts", "event_type"), "window_start timestamp, window_end timestamp, event_type string, n long", ["window_start", "event_type"])
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(
    "k03_silent",
    """WITH c AS (SELECT DISTINCT date_trunc('hour', ts) - to_hours(CAST(h AS INT)) AS w, event_type AS s FROM events, (SELECT unnest(range(0, 24)) AS h)), g AS (SELECT w, s FROM (SELECT DISTINCT w FROM c), (SELECT unnest(['view','click','fax']) AS s))
       SELECT CAST(w AS TIMESTAMP) AS window_start, s AS event_type FROM g WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.w = g.w AND c.s = g.s)""",
)
def _(v: DriverViews):
    events = K.file_stream(v.spark, v.folder, "events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows = _counts(v, "silent", K.sliding_counts(events, "ts", "event_type"), "window_start timestamp, window_end timestamp, event_type string, n long", ["window_start", "event_type"])
    quiet = K.silent_in_window(rows, ("view", "click", "fax"), "event_type")
    return quiet.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type")


@query("k04_weeks", "SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(v: DriverViews):
    events = K.file_stream(v.spark, v.folder, "events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows = _counts(v, "weeks", K.weekly_counts(events, "ts", "event_type"), "week_start timestamp, event_type string, n long", ["week_start", "event_type"])
    return rows.select(F.to_date("week_start").alias("week_start"), "event_type", "n")


@query("k04_months", "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(v: DriverViews):
    events = K.file_stream(v.spark, v.folder, "events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    days = _counts(v, "months", K.daily_counts(events, "ts", "event_type"), "day timestamp, event_type string, n long", ["day", "event_type"])
    return K.months_of(days, "event_type")


@query("k05_seen", duck_sql("SELECT watchlist_id, count(*) AS n, count(*) FILTER (is_new) AS fresh FROM feed GROUP BY 1", *_WATCH_VIEWS, ctes=_WATCHED))
def _(v: DriverViews):
    folder = scratch(v.spark, "seen")
    events = K.file_stream(v.spark, v.folder, "events.parquet").selectExpr("event_id", "user_id AS project_id", "event_type", "ts AS created_at")
    marked = K.seen_markers(events, v.watchlist_items, v.watchlists, v.projects).select("watchlist_id", "event_id", "is_new")
    K.run_available(marked, K.update_job(f"{folder}/store"), f"{folder}/checkpoint")
    rows = K.read_batches(v.spark, f"{folder}/store", "watchlist_id int, event_id long, is_new boolean")
    return rows.groupBy("watchlist_id").agg(F.count("*").alias("n"), F.count_if("is_new").alias("fresh"))


_LINES = """lines AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS position FROM documents),
headed AS (SELECT document_id, position // 10 + 1 AS page, position, text, FALSE AS is_table, regexp_extract(trim(text, ' ' || chr(9) || chr(13)), '^([^\\r\\n]*)', 1) AS line FROM lines),
found AS (SELECT *, CASE WHEN length(line) BETWEEN 1 AND 120 THEN coalesce(nullif(regexp_extract(line, '(?i)^\\s*(item\\s+\\d+[a-z]?\\b.*)$', 1), ''),
    nullif(regexp_extract(line, '^\\s*((?:[IVXLC]+)[.)]\\s+[A-Z].*)$', 1), ''), nullif(regexp_extract(line, '^\\s*(\\d{1,2}(?:\\.\\d{1,2})*[.)]?\\s+[A-Z].*)$', 1), '')) END AS head FROM headed),
sections AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, position ROWS UNBOUNDED PRECEDING) AS section FROM found)"""


@query(
    "k06_chunk_store",
    f"""WITH RECURSIVE {_LINES}, {chunks_sql("sections")}
        SELECT p.*, p.document_id || '-' || p.chunk_index AS chunk_id, EXISTS (SELECT 1 FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.text = p.content) AS reused FROM packed p""",
)
def _(v: DriverViews):
    """Documents come in three deliveries, each with lines of every document; the query is started anew for each."""
    folder = scratch(v.spark, "chunks")
    split = F.split("text", "\n")
    lines = v.documents.filter("text IS NOT NULL").select(F.col("doc_id").alias("document_id"), F.size(split).cast("long").alias("blocks"), F.posexplode(split).alias("position", "text"))
    blocks = lines.select(
        "document_id", (F.floor(F.col("position") / 10) + 1).cast("int").alias("page"), F.col("position").cast("long").alias("position"), "text",
        F.lit(False).alias("is_table"), "blocks", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.pmod("position", F.lit(3))).alias("seen_at"),
    )
    texts = v.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    vectors = texts.join(v.table("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")
    for delivery in range(3):
        blocks.filter(F.pmod("position", F.lit(3)) == delivery).write.mode("append").parquet(f"{folder}/blocks")
        arriving = v.spark.readStream.schema(blocks.schema).parquet(f"{folder}/blocks")
        stream, store = K.chunk_job(S.whole_documents(arriving), vectors, f"{folder}/store")
        K.run_available(stream, store, f"{folder}/checkpoint")
    return K.current_chunks(v.spark, f"{folder}/store")


@query(
    "k03_source_silence",
    """SELECT 'user ' || user_id AS source, CAST(ts AS TIMESTAMP) AS silent_from, CAST(next AS TIMESTAMP) AS silent_to
       FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM (SELECT DISTINCT user_id, date_trunc('millisecond', ts) AS ts FROM events))
       WHERE next - ts > INTERVAL 24 HOUR""",
)
def _(v: DriverViews):
    """Gaps of more than a day between a source's events, each told by the source's own state."""
    folder = scratch(v.spark, "silence")
    events = K.file_stream(v.spark, v.folder, "events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("source"))
    K.run_available(S.silent_sources(events, "ts", "source"), K.update_job(f"{folder}/store"), f"{folder}/checkpoint")
    rows = K.read_batches(v.spark, f"{folder}/store", S.SILENCE).filter("silent_to IS NOT NULL")
    return rows.select("source", F.col("silent_from").cast("timestamp_ntz").alias("silent_from"), F.col("silent_to").cast("timestamp_ntz").alias("silent_to"))


@query("k07_resumed", "SELECT count(*) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM documents")
def _(v: DriverViews):
    """Two runs over one checkpoint: the second finds nothing new and adds nothing."""
    folder = scratch(v.spark, "resume")
    for _run in range(2):
        stream = K.file_stream(v.spark, v.folder, "documents.parquet", per_trigger=1).select("doc_id")
        K.run_available(stream, K.update_job(f"{folder}/store"), f"{folder}/checkpoint")
    rows = K.read_batches(v.spark, f"{folder}/store", "doc_id long")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))
