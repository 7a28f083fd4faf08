"""Registered queries on estimate, study and intercept history."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.figures import contained_metal
from ..operators import history as H
from .driver_views import AS_OF_FILINGS, DriverViews, duck_sql
from .registry import query

AS_OF = date.fromisoformat(AS_OF_FILINGS)
DAY = f"DATE '{AS_OF_FILINGS}'"

ESTIMATES = """
dated AS (
  SELECT r.*, f.filed_at, coalesce(r.effective_date, f.filed_at) AS estimate_date,
         CASE WHEN category IN ('measured+indicated','measured','indicated') THEN 'mi'
              WHEN category IN ('2p','proven','probable') THEN 'reserves'
              WHEN category = 'inferred' THEN 'inferred' ELSE 'other' END AS grp,
         category IN ('measured+indicated','2p') AS combined,
         coalesce(regexp_matches(lower(trim(domain)), '^(grand |overall |project )?total\\b|[-–—:]\\s*total$'), false) AS is_total
  FROM resources r LEFT JOIN filings f ON r.document_id = f.document_id
  WHERE coalesce(r.effective_date, f.filed_at) IS NOT NULL),
docs AS (SELECT project_id, estimate_date, document_id, count(*) AS row_count, max(filed_at) AS filed FROM dated GROUP BY ALL),
best AS (
  SELECT *, count(*) OVER (PARTITION BY project_id, estimate_date) - 1 AS also_in FROM docs
  QUALIFY row_number() OVER (PARTITION BY project_id, estimate_date
                             ORDER BY row_count DESC, filed DESC NULLS LAST, document_id) = 1),
kept AS (SELECT d.* FROM dated d JOIN best b USING (project_id, estimate_date, document_id)),
flags AS (SELECT project_id, estimate_date, grp, bool_or(combined) AS any_combined FROM kept GROUP BY ALL),
level AS (SELECT k.* FROM kept k JOIN flags f USING (project_id, estimate_date, grp)
          WHERE k.grp IN ('inferred','other') OR k.combined = f.any_combined),
wins AS (SELECT project_id, estimate_date, grp,
                count(*) FILTER (is_total) > 0 AND count(*) FILTER (is_total) < count(*) AS totals_win FROM level GROUP BY ALL),
chosen AS (SELECT l.* FROM level l JOIN wins w USING (project_id, estimate_date, grp) WHERE NOT w.totals_win OR l.is_total),
totals AS (
  SELECT project_id, estimate_date, document_id, grp, count(*) AS row_count,
         sum(tonnes) FILTER (tonnes > 0) AS tonnes,
         sum(au * tonnes) FILTER (tonnes > 0) / sum(tonnes) FILTER (tonnes > 0 AND au IS NOT NULL) AS au,
         sum(cu * tonnes) FILTER (tonnes > 0) / sum(tonnes) FILTER (tonnes > 0 AND cu IS NOT NULL) AS cu
  FROM chosen WHERE grp <> 'other' GROUP BY ALL HAVING sum(tonnes) FILTER (tonnes > 0) > 0),
wide AS (
  SELECT b.project_id, b.estimate_date, b.document_id, b.also_in, b.row_count,
         max(t.tonnes) FILTER (t.grp = 'mi') AS mi, max(t.tonnes) FILTER (t.grp = 'inferred') AS inf,
         max(t.tonnes) FILTER (t.grp = 'reserves') AS res,
         max(t.au) FILTER (t.grp = 'mi') AS mi_au, max(t.cu) FILTER (t.grp = 'mi') AS mi_cu,
         max(t.au) FILTER (t.grp = 'inferred') AS inf_au, max(t.cu) FILTER (t.grp = 'inferred') AS inf_cu
  FROM best b LEFT JOIN totals t USING (project_id, estimate_date) GROUP BY ALL),
keyn AS (SELECT project_id, estimate_date, count(au) AS n_au, count(cu) AS n_cu FROM kept GROUP BY ALL),
seq AS (
  SELECT w.*, n_au + coalesce(lag(n_au) OVER p, 0) AS c_au, n_cu + coalesce(lag(n_cu) OVER p, 0) AS c_cu,
         lag(estimate_date) OVER p AS prev_date, lag(mi) OVER p AS prev_mi, lag(inf) OVER p AS prev_inf,
         lag(mi_au) OVER p AS p_mi_au, lag(mi_cu) OVER p AS p_mi_cu, lag(inf_au) OVER p AS p_inf_au, lag(inf_cu) OVER p AS p_inf_cu
  FROM wide w JOIN keyn USING (project_id, estimate_date)
  WINDOW p AS (PARTITION BY project_id ORDER BY estimate_date)),
keyed AS (SELECT *, CASE WHEN c_au = 0 AND c_cu = 0 THEN NULL WHEN c_au >= c_cu THEN 'Au_gpt' ELSE 'Cu_pct' END AS metal_key FROM seq),
metals AS (
  SELECT *,
    CASE metal_key
      WHEN 'Au_gpt' THEN CASE WHEN mi_au IS NOT NULL OR inf_au IS NOT NULL THEN coalesce(mi * mi_au / 31.1035, 0) + coalesce(inf * inf_au / 31.1035, 0) END
      WHEN 'Cu_pct' THEN CASE WHEN mi_cu IS NOT NULL OR inf_cu IS NOT NULL THEN coalesce(mi * mi_cu / 100, 0) + coalesce(inf * inf_cu / 100, 0) END END AS metal,
    CASE metal_key
      WHEN 'Au_gpt' THEN CASE WHEN p_mi_au IS NOT NULL OR p_inf_au IS NOT NULL THEN coalesce(prev_mi * p_mi_au / 31.1035, 0) + coalesce(prev_inf * p_inf_au / 31.1035, 0) END
      WHEN 'Cu_pct' THEN CASE WHEN p_mi_cu IS NOT NULL OR p_inf_cu IS NOT NULL THEN coalesce(prev_mi * p_mi_cu / 100, 0) + coalesce(prev_inf * p_inf_cu / 100, 0) END END AS prev_metal
  FROM keyed),
pcts AS (
  SELECT *, (mi - prev_mi) / nullif(abs(prev_mi), 0) * 100 AS mi_pct, (inf - prev_inf) / nullif(abs(prev_inf), 0) * 100 AS inferred_pct,
         (metal - prev_metal) / nullif(abs(prev_metal), 0) * 100 AS metal_pct FROM metals),
deltas AS (
  SELECT *, coalesce(greatest(abs(mi_pct), abs(inferred_pct), abs(metal_pct)) > 300, false) AS scope_change FROM pcts),
lines AS (
  SELECT *, CASE WHEN (mi_pct IS NOT NULL OR inferred_pct IS NOT NULL) THEN
    concat_ws(', ', CASE WHEN abs(mi_pct) < 0.5 THEN 'M&I tonnes unchanged' WHEN mi_pct IS NOT NULL
                      THEN 'M&I ' || CASE WHEN mi_pct > 0 THEN '+' ELSE '−' END || CAST(round(abs(mi_pct)) AS BIGINT) || '% tonnes' END,
                    CASE WHEN abs(inferred_pct) < 0.5 THEN 'Inferred tonnes unchanged' WHEN inferred_pct IS NOT NULL
                      THEN 'Inferred ' || CASE WHEN inferred_pct > 0 THEN '+' ELSE '−' END || CAST(round(abs(inferred_pct)) AS BIGINT) || '% tonnes' END)
    || ' vs the ' || strftime(prev_date, '%Y') || ' estimate'
    || CASE WHEN scope_change THEN ' (likely a change in scope; check the report)' ELSE '' END END AS change FROM deltas)
"""


def _history(body: str, *more: str) -> str:
    return duck_sql(body, "resources", "filings", *more, ctes=ESTIMATES)


@query("h01_estimates", _history("SELECT project_id, estimate_date, document_id, also_in, row_count FROM best"))
def _(v: DriverViews):
    return H.chosen_documents(H.dated_resources(v.resources, v.filings)).select("project_id", "estimate_date", "document_id", "also_in", "row_count")


@query(
    "h03_weighted_totals",
    _history(
        "SELECT project_id, estimate_date, grp, row_count, round(tonnes, 2) AS tonnes, round(au, 4) AS au_gpt, round(cu, 4) AS cu_pct FROM totals"
    ),
)
def _(v: DriverViews):
    grade = lambda k: F.round(F.try_element_at("grades", F.lit(k)), 4)
    return H.category_totals(v.resources, v.filings).select(
        "project_id", "estimate_date", "grp", "row_count", F.round("tonnes", 2).alias("tonnes"),
        grade("Au_gpt").alias("au_gpt"), grade("Cu_pct").alias("cu_pct"),
    )


@query(
    "h04_contained",
    _history(
        """SELECT project_id, estimate_date, grp, round(tonnes * au / 31.1035, 6) AS gold_oz, round(tonnes * cu / 100, 6) AS copper_t FROM totals"""
    ),
)
def _(v: DriverViews):
    def metal(key: str):
        k = F.lit(key)
        return F.round(contained_metal("tonnes", k, F.try_element_at("grades", k)), 6)

    return H.category_totals(v.resources, v.filings).select(
        "project_id", "estimate_date", "grp", metal("Au_gpt").alias("gold_oz"), metal("Cu_pct").alias("copper_t")
    )


@query(
    "h05_primary_key",
    duck_sql(
        """SELECT project_id, CASE WHEN count(au) >= count(cu) THEN 'Au_gpt' ELSE 'Cu_pct' END AS grade_key,
                  greatest(count(au), count(cu)) AS key_rows
           FROM resources GROUP BY project_id HAVING count(au) + count(cu) > 0""",
        "resources",
    ),
)
def _(v: DriverViews):
    return H.primary_grade_keys(v.resources)


@query(
    "h08_zone_matrix",
    _history(
        """, ranked AS (SELECT project_id, estimate_date, row_number() OVER (PARTITION BY project_id ORDER BY estimate_date DESC) AS age
                        FROM (SELECT DISTINCT project_id, estimate_date FROM best)),
           zones AS (SELECT c.project_id, c.grp, c.estimate_date, c.estimate_id, c.tonnes,
                  CASE WHEN z = '' THEN 'total' ELSE z END AS zone
             FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(coalesce(domain, 'total')),
                     '\\b(mine|tailings|complex|dam|deposit|project|the|of|underground|ug|open pit|op|inclusive|exclusive|reserves?)\\b', ' ', 'g'),
                     '[^a-z0-9]+', ' ', 'g')) AS z FROM chosen WHERE grp <> 'other') c),
           cells AS (SELECT project_id, grp, zone, age, arg_min(tonnes, estimate_id) AS tonnes
                     FROM zones JOIN ranked USING (project_id, estimate_date) WHERE age <= 4 GROUP BY ALL)
           SELECT project_id, grp, zone, max(tonnes) FILTER (age = 4) AS estimate_4_back, max(tonnes) FILTER (age = 3) AS estimate_3_back,
                  max(tonnes) FILTER (age = 2) AS estimate_2_back, max(tonnes) FILTER (age = 1) AS estimate_1_back
           FROM cells GROUP BY ALL"""
    ),
)
def _(v: DriverViews):
    return H.zone_matrix(v.resources, v.filings)


@query(
    "h09_zone_change",
    _history(
        """, ranked AS (SELECT project_id, estimate_date, row_number() OVER (PARTITION BY project_id ORDER BY estimate_date DESC) AS age,
                               count(*) OVER (PARTITION BY project_id) AS n_estimates
                        FROM (SELECT DISTINCT project_id, estimate_date FROM best)),
           zones AS (SELECT *, CASE WHEN z = '' THEN 'total' ELSE z END AS zone
             FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(coalesce(domain, 'total')),
                     '\\b(mine|tailings|complex|dam|deposit|project|the|of|underground|ug|open pit|op|inclusive|exclusive|reserves?)\\b', ' ', 'g'),
                     '[^a-z0-9]+', ' ', 'g')) AS z FROM chosen WHERE grp <> 'other')),
           cells AS (SELECT project_id, grp, zone, age, any_value(n_estimates) AS n_estimates, arg_min(tonnes, estimate_id) AS tonnes
                     FROM zones JOIN ranked USING (project_id, estimate_date) WHERE age <= 4 GROUP BY ALL),
           two AS (SELECT project_id, grp, zone, any_value(n_estimates) AS n, max(tonnes) FILTER (age = 1) AS now_t, max(tonnes) FILTER (age = 2) AS before_t
                   FROM cells GROUP BY ALL)
           SELECT project_id, grp, zone,
                  CASE WHEN now_t IS NOT NULL AND before_t IS NOT NULL THEN 'changed' WHEN now_t IS NOT NULL AND n >= 2 THEN 'new'
                       WHEN before_t IS NOT NULL AND now_t IS NULL THEN 'not reported' END AS state,
                  round((now_t - before_t) / nullif(abs(before_t), 0) * 100, 2) AS pct
           FROM two"""
    ),
)
def _(v: DriverViews):
    return H.zone_changes(v.resources, v.filings).select("project_id", "grp", "zone", "state", F.round("pct", 2).alias("pct"))


_PCT = "round(mi_pct, 2) AS mi_pct, round(inferred_pct, 2) AS inferred_pct, round(metal_pct, 2) AS metal_pct"


def _rounded():
    return [F.round(c, 2).alias(c) for c in ("mi_pct", "inferred_pct", "metal_pct")]


@query(
    "h10_metal_bars",
    _history("SELECT project_id, estimate_date, metal_key, round(metal, 6) AS metal FROM lines WHERE metal IS NOT NULL"),
)
def _(v: DriverViews):
    rows = H.estimate_deltas(v.resources, v.filings).filter(F.col("metal").isNotNull())
    return rows.select("project_id", "estimate_date", "metal_key", F.round("metal", 6).alias("metal"))


@query(
    "h14_delta",
    _history(f"SELECT project_id, estimate_date, prev_date, metal_key, {_PCT}, scope_change, change FROM lines"),
)
def _(v: DriverViews):
    return H.estimate_deltas(v.resources, v.filings).select(
        "project_id", "estimate_date", "prev_date", "metal_key", *_rounded(), "scope_change", "change"
    )


@query(
    "h14_change_for_document",
    _history(
        """SELECT d.project_id, d.document_id, l.change
           FROM (SELECT project_id, document_id, min(estimate_date) AS estimate_date FROM dated GROUP BY ALL) d
           LEFT JOIN lines l USING (project_id, estimate_date)"""
    ),
)
def _(v: DriverViews):
    return H.change_for_documents(v.resources, v.filings)


STUDIES = """
figured AS (
  SELECT e.*, f.filed_at, coalesce(e.effective_date, f.filed_at) AS study_date
  FROM economics e LEFT JOIN filings f ON e.document_id = f.document_id
  WHERE coalesce(npv_value, irr_pct, capex_initial, mine_life_years) IS NOT NULL),
studies AS (
  SELECT * FROM figured
  QUALIFY row_number() OVER (PARTITION BY project_id, study_type, study_date, npv_value ORDER BY study_id) = 1)
"""


def _studies(body: str, *more: str, extra: str = "") -> str:
    return duck_sql(body, "economics", "filings", *more, ctes=STUDIES + extra)


@query(
    "h11_headline_npv",
    duck_sql(
        """SELECT study_id, npv_key, round(npv_value, 6) AS npv_value,
             CASE npv_key WHEN 'post_tax_5pct' THEN 'post-tax, 5%' WHEN 'post_tax_8pct' THEN 'post-tax, 8%'
                          WHEN 'pre_tax' THEN 'pre-tax, rate not stated' END AS basis FROM economics""",
        "economics",
    ),
)
def _(v: DriverViews):
    from ..functions.figures import headline_npv

    return v.economics.select("study_id", headline_npv("npv").alias("h")).select(
        "study_id", F.col("h.key").alias("npv_key"), F.round("h.value", 6).alias("npv_value"), F.col("h.basis").alias("basis")
    )


@query("h12_progression", _studies("SELECT project_id, study_id, study_type, study_date, npv_key, round(npv_value, 6) AS npv_value FROM studies"))
def _(v: DriverViews):
    return H.study_progression(v.economics, v.filings).select(
        "project_id", "study_id", "study_type", "study_date", F.col("headline.key").alias("npv_key"), F.round("npv_value", 6).alias("npv_value")
    )


@query(
    "h13_study_change",
    _studies(
        """, pairs AS (
             SELECT *, lag(study_id) OVER w AS b_id, lag(npv_key) OVER w AS b_key, lag(currency) OVER w AS b_cur,
                    lag(npv_value) OVER w AS b_npv, lag(irr_pct) OVER w AS b_irr, lag(capex_initial) OVER w AS b_capex,
                    lag(aisc) OVER w AS b_aisc, lag(mine_life_years) OVER w AS b_life, lag(payback_years) OVER w AS b_pay,
                    row_number() OVER (PARTITION BY project_id ORDER BY study_date DESC NULLS LAST, study_id DESC) AS rn
             FROM studies WINDOW w AS (PARTITION BY project_id ORDER BY study_date ASC NULLS FIRST, study_id)),
           newest AS (SELECT * FROM pairs WHERE rn = 1 AND b_id IS NOT NULL),
           metrics AS (
             SELECT project_id, 'npv' AS metric, b_npv AS before, npv_value AS now, coalesce(npv_key = b_key AND currency = b_cur, false) AS comparable, false AS inverted FROM newest
             UNION ALL SELECT project_id, 'irr', b_irr, irr_pct, true, false FROM newest
             UNION ALL SELECT project_id, 'capex', b_capex, capex_initial, currency = b_cur, true FROM newest
             UNION ALL SELECT project_id, 'aisc', b_aisc, aisc, true, true FROM newest
             UNION ALL SELECT project_id, 'mine_life', b_life, mine_life_years, true, false FROM newest
             UNION ALL SELECT project_id, 'payback', b_pay, payback_years, true, true FROM newest),
           p AS (SELECT *, CASE WHEN comparable THEN (now - before) / nullif(abs(before), 0) * 100 END AS pct FROM metrics)
           SELECT project_id, metric, round(before, 6) AS before, round(now, 6) AS now, comparable, round(pct, 2) AS pct,
                  round(CASE WHEN inverted THEN 0.0 - pct ELSE pct END, 2) AS improvement FROM p"""
    ),
)
def _(v: DriverViews):
    rows = H.study_changes(v.economics, v.filings)
    return rows.select(
        "project_id", "metric", F.round("before", 6).alias("before"), F.round("now", 6).alias("now"), "comparable",
        F.round("pct", 2).alias("pct"), F.round("improvement", 2).alias("improvement"),
    )


@query(
    "h15_snapshot",
    duck_sql(
        """SELECT project_id, estimate_date, round(mi, 2) AS mi_tonnes, round(inf, 2) AS inferred_tonnes, change, grade_key, study_type, study_date,
                  round(npv_value, 6) AS npv_value
           FROM (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY estimate_date DESC) = 1)
           FULL JOIN (SELECT project_id, CASE WHEN count(au) >= count(cu) THEN 'Au_gpt' ELSE 'Cu_pct' END AS grade_key
                      FROM resources GROUP BY project_id HAVING count(au) + count(cu) > 0) USING (project_id)
           FULL JOIN (SELECT project_id, study_type, study_date, npv_value FROM studies
                      QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY study_date DESC NULLS LAST, study_id DESC) = 1) USING (project_id)""",
        "resources", "filings", "economics", ctes=ESTIMATES.rstrip() + "," + STUDIES,
    ),
)
def _(v: DriverViews):
    rows = H.snapshots(v.resources, v.economics, v.filings)
    return rows.select(
        "project_id", "estimate_date", F.round("mi_tonnes", 2).alias("mi_tonnes"), F.round("inferred_tonnes", 2).alias("inferred_tonnes"),
        "change", "grade_key", "study_type", "study_date", F.round("npv_value", 6).alias("npv_value"),
    )


def _movers_sql(days: int, limit: int) -> str:
    return _history(
        f""", recent AS (SELECT l.*, p.name AS project_name, c.name AS company_name, coalesce(mi_pct, inferred_pct, metal_pct) IS NOT NULL AS has_delta
                         FROM lines l JOIN filings f USING (document_id) JOIN projects p ON p.project_id = l.project_id
                              LEFT JOIN companies c ON c.company_id = p.company_id
                         WHERE f.filed_at >= {DAY} - {days}),
              newest AS (SELECT *, CASE WHEN NOT has_delta THEN 2 WHEN scope_change THEN 1 ELSE 0 END AS move_class,
                                CASE WHEN has_delta THEN greatest(abs(coalesce(metal_pct, 0)), abs(coalesce(mi_pct, 0)), abs(coalesce(inferred_pct, 0))) ELSE 0 END AS move_size
                         FROM recent WHERE has_delta OR coalesce(mi, inf) IS NOT NULL
                         QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY estimate_date DESC) = 1)
              SELECT CAST(row_number() OVER o AS INT) AS rank, project_id, project_name, company_name, document_id, estimate_date, move_class,
                     round(move_size, 2) AS move_size, {_PCT}
              FROM newest WINDOW o AS (ORDER BY move_class, move_size DESC, estimate_date DESC, project_id)
              ORDER BY rank LIMIT {limit}""",
        "projects",
    )


@query("h16_movers", _movers_sql(720, 20))
def _(v: DriverViews):
    rows = H.resource_movers(v.resources, v.filings, v.projects, AS_OF, days=720, limit=20, companies=v.companies)
    return rows.select(
        "rank", "project_id", "project_name", "company_name", "document_id", "estimate_date", "move_class", F.round("move_size", 2).alias("move_size"), *_rounded()
    )


@query(
    "h17_new_studies",
    _studies(
        f""", recent AS (SELECT DISTINCT e.project_id FROM economics e JOIN filings f USING (document_id) WHERE f.filed_at >= {DAY} - 90),
              full_one AS (
                SELECT *, (npv_value IS NOT NULL)::INT + (irr_pct IS NOT NULL)::INT + (capex_initial IS NOT NULL)::INT
                        + (mine_life_years IS NOT NULL)::INT + (payback_years IS NOT NULL)::INT AS filled
                FROM studies WHERE project_id IN (SELECT project_id FROM recent)
                QUALIFY row_number() OVER (PARTITION BY project_id, document_id ORDER BY filled DESC, study_date ASC NULLS FIRST, study_id) = 1),
              pairs AS (SELECT *, lag(study_type) OVER w AS prev_study_type, lag(npv_value) OVER w AS prev_npv, lag(npv_key) OVER w AS prev_key,
                               lag(currency) OVER w AS prev_cur,
                               row_number() OVER (PARTITION BY project_id ORDER BY study_date DESC NULLS LAST, study_id DESC) AS rn
                        FROM full_one WINDOW w AS (PARTITION BY project_id ORDER BY study_date ASC NULLS FIRST, study_id)),
              shown AS (SELECT pr.project_id, p.name AS project_name, c.name AS company_name, document_id, study_type, study_date, filed_at, npv_value, prev_study_type, prev_npv,
                               CASE WHEN prev_key = npv_key AND prev_cur = currency THEN (npv_value - prev_npv) / nullif(abs(prev_npv), 0) * 100 END AS npv_pct
                        FROM pairs pr JOIN projects p ON p.project_id = pr.project_id LEFT JOIN companies c ON c.company_id = p.company_id WHERE rn = 1 AND filed_at >= {DAY} - 90)
              SELECT CAST(row_number() OVER o AS INT) AS rank, project_id, project_name, company_name, document_id, study_type, study_date, filed_at,
                     round(npv_value, 6) AS npv_value, prev_study_type, round(prev_npv, 6) AS prev_npv, round(npv_pct, 2) AS npv_pct
              FROM shown WINDOW o AS (ORDER BY filed_at DESC NULLS LAST, project_id) ORDER BY rank LIMIT 10""",
        "projects",
    ),
)
def _(v: DriverViews):
    rows = H.new_studies(v.economics, v.filings, v.projects, AS_OF, companies=v.companies).drop("company_id")
    return rows.withColumns({"npv_value": F.round("npv_value", 6), "prev_npv": F.round("prev_npv", 6), "npv_pct": F.round("npv_pct", 2)})


WIDTH = """scored AS (
  SELECT *, coalesce(interval_m, to_m - from_m) AS width, {g} * coalesce(interval_m, to_m - from_m) AS score
  FROM drills WHERE {g} > 0 AND coalesce(interval_m, to_m - from_m) > 0)"""
BEST_HOLE = """best AS (SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY project_id, coalesce(hole_id, drill_id) ORDER BY score DESC, drill_id) = 1)"""
_RANKED = "SELECT CAST(row_number() OVER (ORDER BY score DESC, drill_id) AS INT) AS rank, drill_id, project_id, hole_id, width, {g} AS assay, round(score, 4) AS score FROM {t} ORDER BY rank LIMIT {n}"


@query("h18_intercepts", duck_sql(_RANKED.format(g="au", t="scored", n=8), "drills", ctes=WIDTH.format(g="au")))
def _(v: DriverViews):
    rows = H.rank_intercepts(v.drills, "Au_gpt")
    return rows.select("rank", "drill_id", "project_id", "hole_id", "width", "assay", F.round("score", 4).alias("score"))


@query("h18_intercepts_per_hole", duck_sql(_RANKED.format(g="cu", t="best", n=25), "drills", ctes=WIDTH.format(g="cu") + "," + BEST_HOLE))
def _(v: DriverViews):
    rows = H.rank_intercepts(v.drills, "Cu_pct", limit=25, per_hole=True)
    return rows.select("rank", "drill_id", "project_id", "hole_id", "width", "assay", F.round("score", 4).alias("score"))


@query(
    "h19_main_assay",
    duck_sql(
        """SELECT project_id, CASE WHEN count(au) >= count(cu) THEN 'Au_gpt' ELSE 'Cu_pct' END AS assay_key, greatest(count(au), count(cu)) AS key_rows
           FROM drills GROUP BY project_id HAVING count(au) + count(cu) > 0""",
        "drills",
    ),
)
def _(v: DriverViews):
    return H.main_assay_keys(v.drills)


@query(
    "h20_side_by_side",
    duck_sql(
        """SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, drill_id) AS INT) AS rank, drill_id, round(score, 4) AS score
           FROM (SELECT * FROM (
                  SELECT 'Au_gpt' AS key, *, au * coalesce(interval_m, to_m - from_m) AS score FROM drills WHERE au > 0 AND coalesce(interval_m, to_m - from_m) > 0
                  UNION ALL
                  SELECT 'Cu_pct' AS key, *, cu * coalesce(interval_m, to_m - from_m) AS score FROM drills WHERE cu > 0 AND coalesce(interval_m, to_m - from_m) > 0)
                 QUALIFY row_number() OVER (PARTITION BY key, project_id, coalesce(hole_id, drill_id) ORDER BY score DESC, drill_id) = 1)
           QUALIFY rank <= 8""",
        "drills",
    ),
)
def _(v: DriverViews):
    return H.rank_intercepts_by_key(v.drills).select("key", "rank", "drill_id", F.round("score", 4).alias("score"))
