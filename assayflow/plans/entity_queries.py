"""Registered landing, dedupe, resolution and matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import landing as D
from ..operators import listing as L
from ..operators import resolve as R
from ..operators.alerts import add_watchlist_items
from .driver_views import DriverViews, duck_sql
from .registry import query

TECH = "('sk1300','ni43101','jorc','pea','pfs','fs')"
KEY = "trim(regexp_replace(regexp_replace(lower({0}), '\\b(the|project|mine|deposit|property|operation|operations|inc|incorporated|corp|corporation|ltd|limited|plc)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "d01_land",
    """WITH rows AS (SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS external_id, sha256(text) AS sha256 FROM documents),
       known AS (SELECT r.* FROM rows r JOIN labels l USING (doc_id) WHERE l.toxic = 1 OR l.quality = 0),
       fresh AS (SELECT * FROM rows r WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.source = r.source AND k.external_id = r.external_id)
                 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.sha256 = r.sha256))
       SELECT doc_id, source, sha256 FROM fresh QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) = 1""",
)
def _(v: DriverViews):
    rows = D.with_content_hash(v.documents, "text").select("doc_id", "source", F.col("doc_id").cast("string").alias("external_id"), "sha256")
    flagged = v.table("labels").filter("toxic = 1 OR quality = 0").select("doc_id")
    known = rows.join(flagged, "doc_id", "left_semi")
    return D.land_new(rows, known, F.col("doc_id")).select("doc_id", "source", "sha256")


@query(
    "d02_event_dedupe",
    duck_sql(
        """SELECT event_id, project_id, document_id, event_type FROM project_events
           QUALIFY document_id IS NULL OR row_number() OVER (PARTITION BY project_id, document_id, event_type ORDER BY event_id) = 1""",
        "project_events",
    ),
)
def _(v: DriverViews):
    return D.dedupe_events(v.events).select("event_id", "project_id", "document_id", "event_type")


_OLDNEW = """old AS (SELECT estimate_id, document_id, tonnes, reviewed AND category = 'inferred' AS reviewed FROM resources WHERE extraction_confidence >= 0.8),
new AS (SELECT estimate_id, document_id, tonnes, false AS reviewed FROM resources WHERE extraction_confidence < 0.7),
guarded AS (SELECT DISTINCT document_id FROM old WHERE reviewed)"""


def _old_new(v: DriverViews):
    columns = ["estimate_id", "document_id", "tonnes"]
    old = v.resources.filter("extraction_confidence >= 0.8").select(*columns, (F.col("reviewed") & (F.col("category") == "inferred")).alias("reviewed"))
    new = v.resources.filter("extraction_confidence < 0.7").select(*columns, F.lit(False).alias("reviewed"))
    return old, new


@query(
    "d03_replace",
    duck_sql(
        """SELECT estimate_id, document_id, reviewed FROM old WHERE document_id NOT IN (SELECT document_id FROM new WHERE document_id NOT IN (SELECT document_id FROM guarded))
           UNION ALL SELECT estimate_id, document_id, reviewed FROM new WHERE tonnes > 0 AND document_id NOT IN (SELECT document_id FROM guarded)""",
        "resources", ctes=_OLDNEW,
    ),
)
def _(v: DriverViews):
    return D.replace_facts(*_old_new(v)).select("estimate_id", "document_id", "reviewed")


@query(
    "d03_replacement_plan",
    duck_sql(
        """, dnew AS (SELECT document_id, count(*) AS n FROM drills WHERE cu >= 9 GROUP BY 1), rnew AS (SELECT document_id, count(*) AS n FROM new GROUP BY 1),
           dold AS (SELECT DISTINCT document_id FROM drills WHERE reviewed AND cu < 2),
           touched AS (SELECT document_id FROM dnew UNION SELECT document_id FROM rnew),
           grid AS (SELECT t.document_id, 'resources' AS "table", r.n, g.document_id IS NOT NULL AS p FROM touched t LEFT JOIN rnew r USING (document_id) LEFT JOIN guarded g USING (document_id)
                    UNION ALL SELECT t.document_id, 'drills', d.n, g.document_id IS NOT NULL FROM touched t LEFT JOIN dnew d USING (document_id) LEFT JOIN dold g USING (document_id))
           SELECT document_id, "table", CASE WHEN n IS NULL THEN 'keep' WHEN p THEN 'protected' ELSE 'swap' END AS action,
                  CASE WHEN n IS NULL THEN 0 WHEN p THEN -1 ELSE n END AS rows FROM grid""",
        "resources", "drills", ctes=_OLDNEW,
    ),
)
def _(v: DriverViews):
    old, new = _old_new(v)
    copper = F.try_element_at("assays", F.lit("Cu_pct"))
    return D.replacement_plan(
        {"resources": old, "drills": v.drills.filter(copper < 2)}, {"resources": new, "drills": v.drills.filter(copper >= 9)}
    )


@query(
    "d03b_replace_chunks",
    duck_sql(
        """, fresh AS (SELECT document_id, chunk_index, 'new ' || content AS content FROM chunks WHERE source IN ('src1','src2'))
           SELECT document_id, chunk_index, md5(content) AS digest FROM chunks WHERE document_id NOT IN (SELECT document_id FROM fresh)
           UNION ALL SELECT document_id, chunk_index, md5(content) FROM fresh""",
        "chunks",
    ),
)
def _(v: DriverViews):
    stored = v.chunks.select("document_id", "chunk_index", "content", "source")
    fresh = stored.filter(F.col("source").isin("src1", "src2")).withColumn("content", F.concat(F.lit("new "), "content"))
    rows = D.replace_chunks(stored, fresh)
    return rows.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("digest"))


@query(
    "d04_issuer_upsert",
    duck_sql(
        """, stored AS (SELECT profile_number, name, active, industry, 'ON' AS jurisdiction FROM issuers WHERE industry <> 'FURNITURE'),
           listed AS (SELECT profile_number, lower(name) AS name, NOT active AS active, CASE WHEN active THEN industry || '2' END AS industry, CASE WHEN active THEN 'BC' END AS jurisdiction, 1 AS position
                        FROM issuers WHERE industry IN ('FURNITURE','BUILDING')
                      UNION ALL SELECT profile_number, 'z ' || name, active, NULL, 'YT', 2 FROM issuers WHERE industry = 'BUILDING' AND active),
           incoming AS (SELECT * EXCLUDE position FROM listed QUALIFY row_number() OVER (PARTITION BY profile_number ORDER BY position DESC) = 1)
           SELECT coalesce(s.profile_number, i.profile_number) AS profile_number, CASE WHEN i.profile_number IS NOT NULL THEN i.name ELSE s.name END AS name,
                  CASE WHEN i.profile_number IS NOT NULL THEN i.active ELSE s.active END AS active, coalesce(i.industry, s.industry) AS industry, coalesce(i.jurisdiction, s.jurisdiction) AS jurisdiction
           FROM stored s FULL JOIN incoming i ON s.profile_number = i.profile_number""",
        "issuers",
    ),
)
def _(v: DriverViews):
    columns = ["profile_number", "name", "active", "industry", "jurisdiction"]
    stored = v.issuers.filter("industry <> 'FURNITURE'").withColumn("jurisdiction", F.lit("ON")).select(*columns)
    incoming = v.issuers.filter("industry IN ('FURNITURE','BUILDING')").selectExpr(
        "profile_number", "lower(name) AS name", "NOT active AS active", "CASE WHEN active THEN concat(industry, '2') END AS industry", "CASE WHEN active THEN 'BC' END AS jurisdiction", "1 AS position"
    )
    later = v.issuers.filter("industry = 'BUILDING' AND active").selectExpr(
        "profile_number", "concat('z ', name) AS name", "active", "cast(NULL AS string) AS industry", "'YT' AS jurisdiction", "2 AS position"
    )
    return R.upsert_issuers(stored, later.unionByName(incoming))


@query(
    "d05_occurrence_upsert",
    duck_sql(
        """, stored AS (SELECT occurrence_id, name, region, lat, lng FROM occurrences WHERE lat <= 30), listed AS (SELECT occurrence_id, upper(name) AS name, region, lat + 1 AS lat, lng + 1 AS lng, 1 AS position FROM occurrences WHERE lat > 20
             UNION ALL SELECT occurrence_id, 'z ' || name, region, lat + 2, lng + 2, 2 FROM occurrences WHERE lat > 40),
           incoming AS (SELECT * EXCLUDE position FROM listed QUALIFY row_number() OVER (PARTITION BY occurrence_id ORDER BY position DESC) = 1)
           SELECT coalesce(s.occurrence_id, i.occurrence_id) AS external_id, coalesce(i.name, s.name) AS name, coalesce(i.region, s.region) AS region, coalesce(i.lat, s.lat) AS lat, coalesce(i.lng, s.lng) AS lng,
                  CASE WHEN s.occurrence_id IS NOT NULL THEN 7 END AS project_id
           FROM stored s FULL JOIN incoming i ON s.occurrence_id = i.occurrence_id""",
        "occurrences",
    ),
)
def _(v: DriverViews):
    base = v.occurrences.withColumns({"source": F.lit("usgs"), "external_id": F.col("occurrence_id"), "country": F.lit(None).cast("string")})
    columns = ["source", "external_id", "name", "country", "region", "commodities", "lat", "lng"]
    stored = base.filter("lat <= 30").select(*columns, F.lit(7).alias("project_id"))
    incoming = base.filter("lat > 20").select(*columns).withColumns({"name": F.upper("name"), "lat": F.col("lat") + 1, "lng": F.col("lng") + 1, "position": F.lit(1)})
    later = base.filter("lat > 40").select(*columns).withColumns({"name": F.concat(F.lit("z "), "name"), "lat": F.col("lat") + 2, "lng": F.col("lng") + 2, "position": F.lit(2)})
    return R.upsert_occurrences(stored, later.unionByName(incoming)).select("external_id", "name", "region", "lat", "lng", "project_id")


_MENTIONS = """mentions AS (SELECT c_custkey AS mention_id, CASE WHEN c_custkey % 4 = 0 THEN lower(n) ELSE n END AS name,
    CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey // 9 AS VARCHAR), 10, '0') END AS cik
  FROM (SELECT c_custkey, 'Supplier#' || lpad(CAST(c_custkey // 8 AS VARCHAR), 9, '0') AS n FROM customer)),
stored AS (SELECT company_id, CASE WHEN company_id % 10 = 4 THEN 'Supplier#' || lpad(CAST(company_id + 1 AS VARCHAR), 9, '0') ELSE name END AS name, cik FROM companies),
names AS (SELECT lower(name) AS k, count(*) AS n, min(company_id) AS id FROM stored GROUP BY 1),
found AS (SELECT m.*, c.company_id AS cik_id, n.n, n.id AS name_id FROM mentions m LEFT JOIN stored c ON c.cik = m.cik LEFT JOIN names n ON n.k = lower(m.name)),
resolved AS (SELECT mention_id, name, cik, CASE WHEN cik_id IS NOT NULL THEN 'cik' WHEN n = 1 THEN 'name' WHEN n > 1 THEN 'ambiguous' ELSE 'new' END AS how,
    CASE WHEN cik_id IS NOT NULL THEN cik_id WHEN n = 1 THEN name_id END AS company_id,
    CASE WHEN cik_id IS NULL AND n IS NULL THEN sha256(coalesce(cik, lower(name))) END AS new_key FROM found)"""


def _stored_companies(v: DriverViews):
    renamed = F.concat(F.lit("Supplier#"), F.lpad((F.col("company_id") + 1).cast("string"), 9, "0"))
    return v.companies.withColumn("name", F.when(F.col("company_id") % 10 == 4, renamed).otherwise(F.col("name")))


def _resolved(v: DriverViews):
    mentions = v.table("customer").selectExpr(
        "c_custkey AS mention_id", "concat('Supplier#', lpad(cast(c_custkey DIV 8 AS string), 9, '0')) AS n",
        "CASE WHEN c_custkey % 3 = 0 THEN lpad(cast(c_custkey DIV 9 AS string), 10, '0') END AS cik",
    ).selectExpr("mention_id", "CASE WHEN mention_id % 4 = 0 THEN lower(n) ELSE n END AS name", "cik", "CASE WHEN mention_id % 2 = 1 THEN concat('T', mention_id) END AS ticker")
    return R.resolve_companies(mentions, _stored_companies(v))


@query("d06_company", duck_sql("SELECT mention_id, how, company_id, new_key FROM resolved", "companies", ctes=_MENTIONS))
def _(v: DriverViews):
    return _resolved(v).select("mention_id", "how", "company_id", "new_key")


@query(
    "d06_company_updates",
    duck_sql(
        """SELECT s.company_id, coalesce(r.name, s.name) AS name, coalesce(s.cik, c.cik) AS cik, coalesce(CASE WHEN s.company_id % 5 = 0 THEN 'OLD' END, t.ticker) AS ticker FROM stored s
           LEFT JOIN (SELECT company_id, 'T' || min(mention_id) AS ticker FROM resolved WHERE how = 'cik' AND mention_id % 2 = 1 GROUP BY 1) t USING (company_id)
           LEFT JOIN (SELECT company_id, arg_max(name, mention_id) AS name FROM resolved WHERE how = 'cik' GROUP BY 1) r USING (company_id)
           LEFT JOIN (SELECT company_id, arg_min(cik, mention_id) AS cik FROM resolved WHERE how = 'name' AND cik IS NOT NULL GROUP BY 1) c USING (company_id)""",
        "companies", ctes=_MENTIONS,
    ),
)
def _(v: DriverViews):
    stored = _stored_companies(v).withColumn("ticker", F.when(F.col("company_id") % 5 == 0, F.lit("OLD")))
    return R.apply_company_updates(stored, _resolved(v)).select("company_id", "name", "cik", "ticker")


@query("d06_new_companies", duck_sql("SELECT new_key, arg_min(name, mention_id) AS name, count(*) AS mentions FROM resolved WHERE how = 'new' GROUP BY 1", "companies", ctes=_MENTIONS))
def _(v: DriverViews):
    return R.new_companies(_resolved(v)).select("new_key", "name", "mentions")


_PMENTION = f"""pm AS (SELECT p.project_id AS mention_id, p.company_id, c.name AS company_name,
    CASE WHEN p.project_id % 7 = 0 THEN c.name WHEN p.project_id % 11 = 0 THEN ' ' WHEN p.project_id % 5 = 0 THEN 'Fresh ' || p.name ELSE 'The ' || upper(p.name) || ' Mine' END AS project_name
  FROM projects p JOIN companies c USING (company_id)),
ps AS (SELECT company_id, {KEY.format('name')} AS k, count(*) AS n, min(project_id) AS id FROM projects GROUP BY 1, 2),
pr AS (SELECT pm.*, {KEY.format('project_name')} AS k FROM pm),
pres AS (SELECT mention_id, pr.company_id, CASE WHEN trim(project_name) = '' OR pr.k = '' THEN 'empty' WHEN pr.k = {KEY.format('company_name')} THEN 'company_name'
    WHEN ps.n > 1 THEN 'ambiguous' WHEN ps.n = 1 THEN 'linked' ELSE 'new' END AS how, ps.id FROM pr LEFT JOIN ps ON ps.company_id = pr.company_id AND ps.k = pr.k)"""


def _project_mentions(v: DriverViews):
    names = v.companies.select("company_id", F.col("name").alias("company_name"))
    rows = v.projects.join(names, "company_id").selectExpr(
        "project_id AS mention_id", "company_id", "company_name", "upper(country) AS country", "'north' AS region",
        "array('gold', 'Au') AS commodities", "'Pre-Feasibility' AS stage",
        "CASE WHEN project_id % 7 = 0 THEN company_name WHEN project_id % 11 = 0 THEN ' ' WHEN project_id % 5 = 0 THEN concat('Fresh ', name) ELSE concat('The ', upper(name), ' Mine') END AS project_name",
    )
    return R.resolve_projects(rows, v.projects)


@query("d07_project", duck_sql("SELECT mention_id, how, CASE WHEN how = 'linked' THEN id END AS project_id FROM pres", "projects", "companies", ctes=_PMENTION))
def _(v: DriverViews):
    return _project_mentions(v).select("mention_id", "how", "project_id")


@query(
    "d07_fill",
    duck_sql(
        """SELECT p.project_id, coalesce(p.stage, CASE WHEN p.project_id IN (SELECT id FROM pres WHERE how = 'linked') THEN 'pfs' END) AS stage, p.region FROM projects p""",
        "projects", "companies", ctes=_PMENTION,
    ),
)
def _(v: DriverViews):
    return R.fill_projects(v.projects, _project_mentions(v)).select("project_id", "stage", "region")


@query(
    "d08_stamp",
    duck_sql(
        """SELECT f.document_id, coalesce(r.company_id, f.company_id) AS company_id, coalesce(CASE WHEN r.company_id % 2 = 0 THEN r.company_id END, f.project_id) AS project_id,
                  length(r.s) AS summary_size FROM filings f
           LEFT JOIN (SELECT mention_id AS document_id, company_id, substr(repeat('summary ', 100), 1, 500) AS s FROM resolved) r USING (document_id)""",
        "filings", "companies", ctes=_MENTIONS,
    ),
)
def _(v: DriverViews):
    resolved = _resolved(v).select(
        F.col("mention_id").alias("document_id"), "company_id", F.when(F.col("company_id") % 2 == 0, F.col("company_id")).alias("project_id"),
        F.repeat(F.lit("summary "), F.lit(100)).alias("summary"),
    )
    rows = R.stamp_documents(v.filings, resolved)
    return rows.select("document_id", "company_id", "project_id", F.length("summary").cast("long").alias("summary_size"))


_PLAN = """bare AS (SELECT document_id, source, CASE WHEN source = 'edgar' THEN 'Supplier#' || lpad(CAST(document_id % 150 AS VARCHAR), 9, '0') || '  (SUP, SUP-PA)'
      WHEN document_id % 2 = 0 THEN 'supplier#' || lpad(CAST(document_id % 150 AS VARCHAR), 9, '0') || ' — Technical report (NI 43-101)' ELSE title END AS title,
    CASE WHEN source = 'edgar' AND document_id % 4 <> 0 THEN 'https://archive/edgar/data/' || (document_id % 150) || '/x.htm' END AS source_url
  FROM filings WHERE company_id IS NULL),
ident AS (SELECT *, CASE WHEN source = 'edgar' AND source_url IS NOT NULL THEN 'Supplier#' || lpad(CAST(document_id % 150 AS VARCHAR), 9, '0')
      WHEN source <> 'edgar' AND document_id % 2 = 0 THEN 'supplier#' || lpad(CAST(document_id % 150 AS VARCHAR), 9, '0') END AS name,
    CASE WHEN source = 'edgar' AND source_url IS NOT NULL THEN lpad(CAST(document_id % 150 AS VARCHAR), 10, '0') END AS cik FROM bare),
linkplan AS (SELECT i.document_id, i.name, coalesce(c.company_id, n.company_id) AS company_id,
    CASE WHEN i.name IS NULL THEN 'no identifier' WHEN coalesce(c.company_id, n.company_id) IS NOT NULL THEN 'link to existing company' ELSE 'company does not exist yet' END AS outcome
  FROM ident i LEFT JOIN companies c ON c.cik = i.cik LEFT JOIN companies n ON lower(n.name) = lower(i.name))"""


def _link_plan(v: DriverViews):
    rows = v.filings.selectExpr(
        "document_id", "company_id", "source",
        "CASE WHEN source = 'edgar' THEN concat('Supplier#', lpad(cast(document_id % 150 AS string), 9, '0'), '  (SUP, SUP-PA)')"
        " WHEN document_id % 2 = 0 THEN concat('supplier#', lpad(cast(document_id % 150 AS string), 9, '0'), ' — Technical report (NI 43-101)') ELSE title END AS title",
        "CASE WHEN source = 'edgar' AND document_id % 4 <> 0 THEN concat('https://archive/edgar/data/', document_id % 150, '/x.htm') END AS source_url",
    )
    return R.link_plan(rows, v.companies)


@query("d09_link_plan", duck_sql("SELECT document_id, name, company_id, outcome FROM linkplan", "filings", "companies", ctes=_PLAN))
def _(v: DriverViews):
    return _link_plan(v).select("document_id", "name", "company_id", "outcome")


@query("d09_missing_names", duck_sql("SELECT name, count(*) AS n FROM linkplan WHERE outcome = 'company does not exist yet' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", "filings", "companies", ctes=_PLAN))
def _(v: DriverViews):
    return R.missing_company_names(_link_plan(v))


_ISSUER_MATCH = """doubled AS (SELECT company_id, name FROM companies UNION ALL SELECT company_id + 1000000, upper(name) FROM companies WHERE company_id % 6 = 0),
m AS (SELECT i.profile_number, i.name, count(d.company_id) AS matches, min(d.company_id) AS id FROM issuers i LEFT JOIN doubled d ON lower(d.name) = lower(i.name) WHERE i.active GROUP BY 1, 2)"""


def _doubled(v: DriverViews):
    twice = v.companies.filter("company_id % 6 = 0").select((F.col("company_id") + 1000000).alias("company_id"), F.upper("name").alias("name"))
    return v.companies.select("company_id", "name").unionByName(twice)


@query("d10_link_issuers", duck_sql("SELECT profile_number, matches, CASE WHEN matches = 1 THEN id END AS company_id FROM m", "issuers", "companies", ctes=_ISSUER_MATCH))
def _(v: DriverViews):
    return R.link_issuers(v.issuers, _doubled(v)).select("profile_number", "matches", "company_id")


@query("d10_report", duck_sql("SELECT profile_number, name, matches, CASE WHEN matches = 0 THEN 'none' ELSE 'ambiguous' END AS reason FROM m WHERE matches <> 1", "issuers", "companies", ctes=_ISSUER_MATCH))
def _(v: DriverViews):
    return R.issuer_report(v.issuers, _doubled(v))


_PERSONS = """stored AS (SELECT c_custkey AS person_id, c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING'),
said AS (SELECT o_orderkey AS document_id, upper(c.c_name) AS name, CASE WHEN o_orderstatus = 'F' THEN 'author' END AS role FROM orders JOIN customer c ON c.c_custkey = o_custkey),
keyed AS (SELECT document_id, name, coalesce(CAST(s.person_id AS VARCHAR), sha256(lower(said.name))) AS person_id, s.person_id IS NULL AS is_new, coalesce(role, '') AS role
          FROM said LEFT JOIN (SELECT lower(name) AS k, min(person_id) AS person_id FROM stored GROUP BY 1) s ON s.k = lower(said.name))"""


def _persons(v: DriverViews):
    customers = v.table("customer")
    stored = customers.filter("c_mktsegment <> 'BUILDING'").selectExpr("c_custkey AS person_id", "c_name AS name", "cast(NULL AS string) AS designation", "cast(NULL AS string) AS firm")
    said = v.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey AS document_id", "upper(c_name) AS name", "cast(NULL AS string) AS designation", "cast(NULL AS string) AS firm",
        "CASE WHEN o_orderstatus = 'F' THEN 'author' END AS role",
    )
    bridge = v.table("orders").filter("o_orderpriority = '5-LOW'").selectExpr("o_orderkey AS document_id", "cast(o_custkey AS string) AS person_id", "'author' AS role")
    return R.upsert_persons(stored, bridge, said)


@query("d11_persons", duck_sql("SELECT CAST(person_id AS VARCHAR) AS person_id, name FROM stored UNION ALL SELECT person_id, min(name) AS name FROM keyed WHERE is_new GROUP BY 1", ctes=_PERSONS))
def _(v: DriverViews):
    return _persons(v)[0].select("person_id", "name")


@query(
    "d11_bridge",
    duck_sql(
        """SELECT document_id, person_id, role FROM keyed UNION SELECT o_orderkey, CAST(o_custkey AS VARCHAR), 'author' FROM orders WHERE o_orderpriority = '5-LOW'""", ctes=_PERSONS
    ),
)
def _(v: DriverViews):
    return _persons(v)[1]


_OCC = f"""ok AS (SELECT *, {KEY.format('name')} AS k, coalesce(commodities, []) AS oc, lower(coalesce(region, '')) AS oreg FROM occurrences),
pk AS (SELECT project_id, {KEY.format('name')} AS k, commodities AS pc, lower(coalesce(region, '')) AS preg FROM projects),
cand AS (SELECT occurrence_id, project_id, list_has_any(pc, oc) AS share, oreg <> '' AND contains(preg, oreg) AS inside, oc, oreg FROM ok JOIN pk ON ok.k = pk.k),
c1 AS (SELECT *, count(*) OVER (PARTITION BY occurrence_id) AS n_all, count(*) FILTER (share) OVER (PARTITION BY occurrence_id) AS n_share FROM cand),
c2 AS (SELECT * FROM c1 WHERE NOT (len(oc) > 0 AND n_all > 1 AND n_share > 0) OR share),
c3 AS (SELECT *, count(*) OVER (PARTITION BY occurrence_id) AS m, count(*) FILTER (inside) OVER (PARTITION BY occurrence_id) AS m_in FROM c2),
c4 AS (SELECT * FROM c3 WHERE NOT (oreg <> '' AND m > 1 AND m_in = 1) OR inside),
fin AS (SELECT occurrence_id, count(*) AS n, min(project_id) AS project_id FROM c4 GROUP BY 1)"""


@query(
    "d12_match",
    duck_sql(
        """SELECT o.occurrence_id, CASE WHEN f.n = 1 THEN f.project_id END AS project_id, CASE WHEN f.n IS NULL THEN 'none' WHEN f.n > 1 THEN 'ambiguous' ELSE 'linked' END AS outcome
           FROM occurrences o LEFT JOIN fin f USING (occurrence_id)""",
        "occurrences", "projects", ctes=_OCC,
    ),
)
def _(v: DriverViews):
    return R.match_occurrences(v.occurrences, v.projects).select("occurrence_id", "project_id", "outcome")


@query(
    "d12_fill_coordinates",
    duck_sql(
        """SELECT p.project_id, CASE WHEN p.lat IS NULL AND p.lng IS NULL THEN x.lat ELSE p.lat END AS lat, CASE WHEN p.lat IS NULL AND p.lng IS NULL THEN x.lng ELSE p.lng END AS lng
           FROM projects p LEFT JOIN (SELECT f.project_id, arg_min(o.lat, o.occurrence_id) AS lat, arg_min(o.lng, o.occurrence_id) AS lng
                                      FROM fin f JOIN occurrences o USING (occurrence_id) WHERE f.n = 1 GROUP BY 1) x USING (project_id)""",
        "occurrences", "projects", ctes=_OCC,
    ),
)
def _(v: DriverViews):
    matched = R.match_occurrences(v.occurrences, v.projects)
    return R.fill_coordinates(v.projects, matched).select("project_id", "lat", "lng")


@query(
    "d12b_manual_links",
    duck_sql(
        """SELECT f.document_id, coalesce(d.quality, f.company_id) AS company_id, coalesce(CASE WHEN d.toxic = 1 THEN 5 END, f.project_id) AS project_id
           FROM filings f LEFT JOIN labels d ON d.doc_id = f.document_id""",
        "filings",
    ),
)
def _(v: DriverViews):
    decisions = v.table("labels").selectExpr("doc_id AS document_id", "cast(quality AS bigint) AS company_id", "CASE WHEN toxic = 1 THEN 5L END AS project_id")
    return R.apply_manual_links(v.filings, decisions, "document_id", ("company_id", "project_id")).select("document_id", "company_id", "project_id")


@query(
    "d13_candidates",
    duck_sql(
        """, found AS (SELECT CAST(document_id // 2 AS VARCHAR) AS external_id, CASE WHEN document_id % 3 = 0 THEN 'u' || (document_id // 2) ELSE '' END AS download_url,
                              CASE WHEN document_id % 5 = 0 THEN 'soon' ELSE CAST(filed_at AS VARCHAR) || 'T00:00' END AS filed FROM filings),
              refs AS (SELECT *, coalesce(nullif(download_url, ''), external_id) AS external_ref FROM found),
              fresh AS (SELECT * FROM refs WHERE external_ref NOT IN (SELECT 'u' || doc_id FROM labels) AND external_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer))
              SELECT external_ref, external_id, TRY_CAST(CASE WHEN regexp_matches(substr(filed, 1, 10), '^\\d{4}-\\d{2}-\\d{2}$') THEN substr(filed, 1, 10) END AS DATE) AS filed_date
              FROM fresh QUALIFY row_number() OVER (PARTITION BY external_ref ORDER BY external_id, filed NULLS FIRST) = 1""",
        "filings",
    ),
)
def _(v: DriverViews):
    found = v.filings.selectExpr(
        "cast(document_id DIV 2 AS string) AS external_id", "CASE WHEN document_id % 3 = 0 THEN concat('u', document_id DIV 2) ELSE '' END AS download_url",
        "CASE WHEN document_id % 5 = 0 THEN 'soon' ELSE concat(filed_at, 'T00:00') END AS filed",
    )
    pending = v.table("labels").selectExpr("concat('u', doc_id) AS external_ref")
    known = v.table("customer").selectExpr("cast(c_custkey AS string) AS external_id")
    return D.new_candidates(found, pending, known).select("external_ref", "external_id", "filed_date")


@query(
    "d13b_profiles",
    duck_sql(
        """, f AS (SELECT document_id, CASE WHEN document_id % 5 <> 0 THEN lpad(CAST(document_id // 10 AS VARCHAR), 9, '0') END AS profile_number FROM filings)
           SELECT document_id, profile_number FROM f WHERE profile_number IS NULL OR profile_number IN (SELECT profile_number FROM issuers WHERE active)""",
        "filings", "issuers",
    ),
)
def _(v: DriverViews):
    rows = v.filings.selectExpr("document_id", "CASE WHEN document_id % 5 <> 0 THEN lpad(cast(document_id DIV 10 AS string), 9, '0') END AS profile_number")
    return D.on_profiles(rows, v.issuers.filter("active")).select("document_id", "profile_number")


@query(
    "d14_worklist",
    duck_sql(
        "SELECT document_id FROM filings f WHERE status = 'indexed' AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.document_id = f.document_id AND job_type = 'extract' AND j.status IN ('pending','running','done'))",
        "filings", "jobs",
    ),
)
def _(v: DriverViews):
    return D.missing_jobs(v.filings, v.jobs).select("document_id")


@query(
    "d14b_force",
    duck_sql(
        f"SELECT document_id FROM filings f WHERE doc_type IN {TECH} AND project_id IS NOT NULL AND status IN ('indexed','triaged','extracted','failed') AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.document_id = f.document_id AND job_type = 'full_extract' AND j.status IN ('pending','running'))",
        "filings", "jobs",
    ),
)
def _(v: DriverViews):
    return D.force_extract(v.filings, v.jobs).select("document_id")


@query(
    "d15_priority",
    duck_sql(
        """, w AS (SELECT document_id, filed_at, EXISTS (SELECT 1 FROM watchlist_items i WHERE i.project_id = f.project_id) OR EXISTS (SELECT 1 FROM watchlist_items i WHERE i.company_id = f.company_id) AS watched FROM filings f)
           SELECT job_id, watched, row_number() OVER (ORDER BY (job_type = 'full_extract') DESC, watched DESC, filed_at DESC NULLS LAST, created_at, job_id) - 1 AS place
           FROM jobs j JOIN w USING (document_id) WHERE j.status = 'pending' AND job_type IN ('extract','full_extract')""",
        "filings", "jobs", "watchlist_items",
    ),
)
def _(v: DriverViews):
    watched = L.on_watchlist(v.filings, v.watchlist_items)
    return D.prioritized(v.jobs, watched).select("job_id", "watched", "place")


_INDEX = """idx AS (SELECT 'Technical Report ' || (o_orderkey % 5) || '.pdf' AS document, 'Customer ' || (o_custkey // 3) AS profile_name,
    CASE WHEN o_custkey % 4 <> 0 THEN lpad(CAST(o_custkey // 3 AS VARCHAR), 9, '0') ELSE '' END AS profile_number, CAST(o_orderdate AS DATE) AS submitted_date, o_orderpriority AS submitted_time,
    CAST(floor(o_totalprice / 200) AS BIGINT) AS file_size_kb FROM orders),
files AS (SELECT o_orderkey AS document_id, 'zip' || (o_custkey % 9) AS archive, CASE WHEN o_orderkey % 17 = 0 THEN 'French ' ELSE '' END || 'TECHNICAL  report ' || (o_orderkey % 5) || '.PDF' AS document,
    CASE WHEN o_orderkey % 6 = 0 THEN 'Customer ' || (o_custkey // 3) ELSE 'CUSTOMER ' || (o_custkey // 3) || ' (formerly Old Co)' END AS company,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey // 3 AS VARCHAR) ELSE '' END AS profile_number, CAST(floor(o_totalprice / 200) AS BIGINT) * 1024 + o_orderkey % 3000 AS size_bytes, o_orderkey % 13 = 0 AS known FROM orders),
ni AS (SELECT DISTINCT trim(regexp_replace(lower(document), '[^a-z0-9]+', ' ', 'g')) AS doc, regexp_replace(trim(profile_number), '^0+', '') AS num, trim(regexp_replace(lower(profile_name), '[^a-z0-9]+', ' ', 'g')) AS party, * FROM idx),
nf AS (SELECT trim(regexp_replace(lower(document), '[^a-z0-9]+', ' ', 'g')) AS doc, regexp_replace(trim(profile_number), '^0+', '') AS num,
       trim(regexp_replace(lower(regexp_replace(company, '(?i)\\(formerly [^)]*\\)', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS party, * FROM files),
cand AS (SELECT f.document_id, i.profile_name, i.submitted_date, i.submitted_time, i.file_size_kb, i.party = f.party AS own FROM nf f JOIN ni i ON i.doc = f.doc
         AND CASE WHEN i.num <> '' AND f.num <> '' THEN i.num = f.num ELSE i.party = f.party END
         AND abs(i.file_size_kb - f.size_bytes / 1024.0) <= greatest(2.0, 0.005 * i.file_size_kb)),
uniq AS (SELECT document_id, min(submitted_date) AS submitted_date, min(submitted_time) AS submitted_time FROM cand GROUP BY 1 HAVING count(DISTINCT (submitted_date, submitted_time, file_size_kb)) = 1),
matched AS (SELECT f.document_id, f.archive, f.document, f.known, u.submitted_date, u.submitted_time FROM files f LEFT JOIN uniq u USING (document_id))"""


def _matched(v: DriverViews):
    orders = v.table("orders")
    index = orders.selectExpr(
        "concat('Technical Report ', o_orderkey % 5, '.pdf') AS document", "concat('Customer ', o_custkey DIV 3) AS profile_name",
        "CASE WHEN o_custkey % 4 <> 0 THEN lpad(cast(o_custkey DIV 3 AS string), 9, '0') ELSE '' END AS profile_number",
        "cast(o_orderdate AS date) AS submitted_date", "o_orderpriority AS submitted_time", "cast(floor(o_totalprice / 200) AS bigint) AS file_size_kb",
    )
    files = orders.selectExpr(
        "o_orderkey AS document_id", "concat('zip', o_custkey % 9) AS archive",
        "concat(CASE WHEN o_orderkey % 17 = 0 THEN 'French ' ELSE '' END, 'TECHNICAL  report ', o_orderkey % 5, '.PDF') AS document",
        "CASE WHEN o_orderkey % 6 = 0 THEN concat('Customer ', o_custkey DIV 3) ELSE concat('CUSTOMER ', o_custkey DIV 3, ' (formerly Old Co)') END AS company",
        "CASE WHEN o_orderkey % 3 <> 0 THEN cast(o_custkey DIV 3 AS string) ELSE '' END AS profile_number",
        "cast(floor(o_totalprice / 200) AS bigint) * 1024 + o_orderkey % 3000 AS size_bytes", "o_orderkey % 13 = 0 AS known",
    )
    return R.match_files(files, index)


@query("d16_band", duck_sql("SELECT document_id, submitted_date, submitted_time FROM matched", ctes=_INDEX))
def _(v: DriverViews):
    return _matched(v).select("document_id", "submitted_date", "submitted_time")


@query(
    "d17_repair",
    duck_sql(
        """SELECT f.document_id, CASE WHEN f.filed_at IS NULL AND m.submitted_date <= CAST(f.created_at AS DATE) THEN m.submitted_date ELSE f.filed_at END AS filed_at,
                  coalesce(f.filed_at IS NULL AND m.submitted_date <= CAST(f.created_at AS DATE), false) AS date_repaired FROM filings f LEFT JOIN matched m USING (document_id)""",
        "filings", ctes=_INDEX,
    ),
)
def _(v: DriverViews):
    return R.repair_dates(v.filings, _matched(v)).select("document_id", "filed_at", "date_repaired")


@query(
    "d17_archive_stats",
    duck_sql(
        """SELECT archive, count(*) AS pdfs, count(*) FILTER (NOT fr AND NOT known AND submitted_date IS NOT NULL) AS matched, count(*) FILTER (NOT fr AND NOT known AND submitted_date IS NULL) AS unmatched,
                  count(*) FILTER (fr) AS french, count(*) FILTER (NOT fr AND known) AS in_db, min(submitted_date) FILTER (NOT fr) AS first_date, max(submitted_date) FILTER (NOT fr) AS last_date
           FROM (SELECT *, contains(lower(document), 'french') AS fr FROM matched) GROUP BY 1""",
        ctes=_INDEX,
    ),
)
def _(v: DriverViews):
    return R.archive_stats(_matched(v))


@query(
    "d17_unmatched_files",
    duck_sql(
        "SELECT m.archive, document_id, m.document, f.company, f.size_bytes FROM matched m JOIN files f USING (document_id) WHERE NOT contains(lower(m.document), 'french') AND NOT m.known AND m.submitted_date IS NULL",
        ctes=_INDEX,
    ),
)
def _(v: DriverViews):
    return R.unmatched_files(_matched(v))


@query(
    "d18_checkpoints",
    """SELECT event_type AS slice, arg_max(props, struct_pack(a := ts, b := event_id)) AS checkpoint FROM events WHERE value > 10 GROUP BY 1""",
)
def _(v: DriverViews):
    runs = v.table("events").selectExpr("event_id AS run_id", "event_type AS slice", "ts AS started_at", "CASE WHEN value > 10 THEN props END AS checkpoint")
    return D.latest_checkpoints(runs)


@query(
    "d19_reuse",
    duck_sql(
        """, stored AS (SELECT md5(text) AS h, min(e.vec_id) AS vec FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.label < 5 GROUP BY 1)
           SELECT doc_id AS document_id, vec IS NOT NULL AS reused, vec AS vec_id FROM documents LEFT JOIN stored ON h = md5(text)"""
    ),
)
def _(v: DriverViews):
    texts = v.documents.select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    vectors = v.table("embeddings").filter("label < 5").select(F.col("vec_id").alias("chunk_id"), F.struct("vec_id", "embedding").alias("embedding"))
    stored = texts.withColumnRenamed("document_id", "chunk_id").join(vectors, "chunk_id")
    return D.reuse_embeddings(texts, stored).select("document_id", "reused", F.col("embedding.vec_id").alias("vec_id"))


@query(
    "d20_watch_items",
    duck_sql(
        """SELECT watchlist_id, project_id, company_id, min(item_id) AS item_id FROM (SELECT watchlist_id, project_id, company_id, item_id FROM watchlist_items
             UNION ALL SELECT watchlist_id, project_id, company_id, item_id + 5000 FROM watchlist_items UNION ALL SELECT watchlist_id, item_id, NULL, item_id + 9000 FROM watchlist_items) GROUP BY ALL""",
        "watchlist_items",
    ),
)
def _(v: DriverViews):
    items = v.watchlist_items
    again = items.withColumn("item_id", F.col("item_id") + 5000)
    fresh = items.select((F.col("item_id") + 9000).alias("item_id"), "watchlist_id", F.col("item_id").alias("project_id"), F.lit(None).cast("bigint").alias("company_id"))
    return add_watchlist_items(items, again.unionByName(fresh))
