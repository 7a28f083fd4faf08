"""Entity resolution and matching: companies, projects, issuers, occurrences, archive files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.columns import blank_to_null
from ..functions.text import filing_identity, plain_name, profile_digits
from .keyed import last_per_key, upsert


def companies_by_cik(companies: DataFrame) -> DataFrame:
    return companies.filter(F.col("cik").isNotNull()).groupBy("cik").agg(F.min("company_id").alias("cik_company"))


def companies_by_name(companies: DataFrame) -> DataFrame:
    """One row per lower-case name: how many companies carry it and the smallest id."""
    return companies.groupBy(F.lower("name").alias("name_key")).agg(
        F.count("*").alias("name_matches"), F.min("company_id").alias("name_company")
    )


def resolve_companies(mentions: DataFrame, companies: DataFrame) -> DataFrame:
    """Each mention (name, cik, ticker) with the company it means and how it was found.

    ``new`` mentions get a key derived from the cik or the lower-case name, so the same new
    company mentioned in many filings gets one key without a global sequence.
    """
    by_cik, by_name = companies_by_cik(companies), companies_by_name(companies)
    rows = mentions.withColumn("name_key", F.lower("name"))
    joined = rows.join(by_cik, "cik", "left").join(by_name, "name_key", "left")
    matches = F.coalesce("name_matches", F.lit(0))
    how = (
        F.when(F.col("cik_company").isNotNull(), F.lit("cik"))
        .when(matches == 1, F.lit("name"))
        .when(matches > 1, F.lit("ambiguous"))
        .otherwise(F.lit("new"))
    )
    company = F.when(how == "cik", F.col("cik_company")).when(how == "name", F.col("name_company"))
    new_key = F.when(how == "new", F.sha2(F.coalesce(F.col("cik"), F.col("name_key")), 256))
    return joined.withColumn("how", how).withColumn("company_id", company).withColumn("new_key", new_key).drop(
        "name_key", "cik_company", "name_matches", "name_company"
    )


def apply_company_updates(companies: DataFrame, resolved: DataFrame) -> DataFrame:
    """Companies after the mentions: a cik match renames and fills a missing ticker, a name match fills a missing cik.

    Names settle by the last mention_id; what fills a gap is the first that has it.
    """
    last = F.col("mention_id")
    renames = resolved.filter((F.col("how") == "cik") & blank_to_null("name").isNotNull()).groupBy("company_id").agg(
        F.max_by("name", last).alias("_name")
    )
    ciks = resolved.filter((F.col("how") == "name") & F.col("cik").isNotNull()).groupBy("company_id").agg(
        F.min_by("cik", last).alias("_cik")
    )
    tickers = resolved.filter((F.col("how") == "cik") & blank_to_null("ticker").isNotNull()).groupBy("company_id").agg(
        F.min_by("ticker", last).alias("_ticker")
    )
    joined = companies.join(renames, "company_id", "left").join(ciks, "company_id", "left").join(tickers, "company_id", "left")
    fresh = {"name": F.coalesce("_name", "name"), "cik": F.coalesce("cik", "_cik"), "ticker": F.coalesce(F.col("ticker"), F.col("_ticker")) if "ticker" in companies.columns else None}
    return joined.select(*[fresh.get(c, F.col(c)).alias(c) for c in companies.columns])


def new_companies(resolved: DataFrame) -> DataFrame:
    fresh = resolved.filter(F.col("how") == "new")
    return fresh.groupBy("new_key").agg(F.min_by(F.struct("name", "cik", "ticker"), "mention_id").alias("c"), F.count("*").alias("mentions")).select(
        "new_key", "c.*", "mentions"
    )


def resolve_projects(mentions: DataFrame, projects: DataFrame) -> DataFrame:
    """Project mentions inside a company: refused, ambiguous, linked or new.

    Stored projects are reduced to one row per (company, normalised name) first, so a company
    holding very many projects under one name still gives a single match row.
    """
    stored = projects.groupBy("company_id", N.project_key("name").alias("project_key")).agg(
        F.count("*").alias("matches"), F.min("project_id").alias("match_id")
    )
    rows = mentions.withColumn("project_key", N.project_key("project_name"))
    joined = rows.join(stored, ["company_id", "project_key"], "left")
    matches = F.coalesce("matches", F.lit(0))
    empty = blank_to_null("project_name").isNull() | (F.coalesce("project_key", F.lit("")) == "")
    how = (
        F.when(empty, F.lit("empty"))
        .when(N.named_like_company("project_name", "company_name"), F.lit("company_name"))
        .when(matches > 1, F.lit("ambiguous"))
        .when(matches == 1, F.lit("linked"))
        .otherwise(F.lit("new"))
    )
    new_key = F.when(how == "new", F.sha2(F.concat_ws("|", "company_id", "project_key"), 256))
    return (
        joined.withColumn("how", how)
        .withColumn("project_id", F.when(how == "linked", F.col("match_id")))
        .withColumn("new_key", new_key)
        .drop("matches", "match_id")
    )


def fill_projects(projects: DataFrame, linked: DataFrame) -> DataFrame:
    """Stored projects with gaps filled from linked mentions; nothing stored is overwritten."""
    order = F.col("mention_id")
    facts = linked.filter(F.col("how") == "linked").groupBy("project_id").agg(
        F.min_by(N.country("country"), F.when(N.country("country").isNotNull(), order)).alias("_country"),
        F.min_by("region", F.when(F.col("region").isNotNull(), order)).alias("_region"),
        F.min_by(N.stage("stage"), F.when(N.stage("stage").isNotNull(), order)).alias("_stage"),
        F.min_by(N.commodities("commodities"), F.when(F.size("commodities") > 0, order)).alias("_commodities"),
    )
    joined = projects.join(facts, "project_id", "left")
    fill = {
        "country": F.coalesce("country", "_country"),
        "region": F.coalesce("region", "_region"),
        "stage": F.coalesce("stage", "_stage"),
        "commodities": F.when(F.size(F.coalesce("commodities", F.array().cast("array<string>"))) == 0, F.coalesce("_commodities", "commodities")).otherwise(F.col("commodities")),
    }
    return joined.select(*[fill.get(c, F.col(c)).alias(c) for c in projects.columns])


def stamp_documents(filings: DataFrame, resolved: DataFrame) -> DataFrame:
    """Filings with resolved ids (new ids win over stored ones) and a summary cut to 500 characters."""
    new = resolved.select(
        "document_id", F.col("company_id").alias("_c"), F.col("project_id").alias("_p"), F.left("summary", F.lit(500)).alias("_s")
    )
    joined = filings.join(new, "document_id", "left")
    changed = {
        "company_id": F.coalesce("_c", "company_id"),
        "project_id": F.coalesce("_p", "project_id"),
        "summary": F.coalesce(F.col("_s"), F.col("summary")) if "summary" in filings.columns else F.col("_s"),
    }
    columns = filings.columns if "summary" in filings.columns else [*filings.columns, "summary"]
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in columns])


def link_plan(filings: DataFrame, companies: DataFrame) -> DataFrame:
    """Filings without a company: what identifies them and which company that is."""
    rows = filings.filter(F.col("company_id").isNull()).drop("company_id")
    identity = filing_identity("source", "title", "source_url")
    rows = rows.withColumn("_i", identity).select("*", F.col("_i.name").alias("name"), F.col("_i.cik").alias("cik"), F.col("_i.ticker").alias("ticker")).drop("_i")
    by_cik, by_name = companies_by_cik(companies), companies_by_name(companies)
    joined = rows.withColumn("name_key", F.lower("name")).join(by_cik, "cik", "left").join(by_name, "name_key", "left")
    company = F.coalesce(F.col("cik_company"), F.when(F.col("name_matches") == 1, F.col("name_company")))
    outcome = (
        F.when(F.col("name").isNull(), F.lit("no identifier"))
        .when(company.isNotNull(), F.lit("link to existing company"))
        .otherwise(F.lit("company does not exist yet"))
    )
    return joined.withColumn("company_id", F.when(F.col("name").isNotNull(), company)).withColumn("outcome", outcome).drop(
        "name_key", "cik_company", "name_matches", "name_company"
    )


def missing_company_names(plan: DataFrame, limit: int = 15) -> DataFrame:
    missing = plan.filter(F.col("outcome") == "company does not exist yet")
    return missing.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(limit)


# --- issuers -----------------------------------------------------------------------------------


def upsert_issuers(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge an issuer list by profile number; inside the list the last row of a number wins.

    ``position`` is the place of a row in the list (file and line).
    """
    one = last_per_key(incoming, ["profile_number"], F.col("position")).drop("position")
    return upsert(stored, one, ["profile_number"], overwrite=["name", "active"], fill=["jurisdiction", "industry"])


def link_issuers(issuers: DataFrame, companies: DataFrame) -> DataFrame:
    """Active issuers with the company of the same lower-case name, when there is exactly one."""
    by_name = companies_by_name(companies)
    rows = issuers.filter("active").withColumn("name_key", F.lower("name")).join(by_name, "name_key", "left")
    matches = F.coalesce("name_matches", F.lit(0)).cast("long")
    return rows.withColumn("matches", matches).withColumn("company_id", F.when(matches == 1, F.col("name_company"))).drop(
        "name_key", "name_matches", "name_company"
    )


def issuer_report(issuers: DataFrame, companies: DataFrame) -> DataFrame:
    """Active issuers matching no company or several."""
    linked = link_issuers(issuers, companies).filter(F.col("matches") != 1)
    reason = F.when(F.col("matches") == 0, F.lit("none")).otherwise(F.lit("ambiguous"))
    return linked.select("profile_number", "name", "matches", reason.alias("reason"))


def upsert_persons(stored: DataFrame, bridge: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Qualified persons by lower-case name and the (document, person, role) bridge.

    New persons are keyed by a hash of the name, so no sequence is shared between tasks.
    """
    known = stored.groupBy(F.lower("name").alias("name_key")).agg(F.min("person_id").alias("_id"))
    rows = mentions.filter(blank_to_null("name").isNotNull()).withColumn("name_key", F.lower("name")).join(known, "name_key", "left")
    key = F.coalesce(F.col("_id").cast("string"), F.sha2("name_key", 256))
    keyed = rows.withColumn("person_id", key)
    fresh = keyed.filter(F.col("_id").isNull()).groupBy("person_id").agg(
        F.min_by(F.struct("name", "designation", "firm"), F.struct("document_id", "name")).alias("p")
    ).select("person_id", "p.*")
    persons = stored.withColumn("person_id", F.col("person_id").cast("string")).unionByName(fresh, allowMissingColumns=True)
    links = keyed.select("document_id", "person_id", F.coalesce("role", F.lit("")).alias("role")).distinct()
    old = bridge.withColumn("person_id", F.col("person_id").cast("string"))
    added = links.join(old, ["document_id", "person_id", "role"], "left_anti")
    return persons, old.unionByName(added)


# --- occurrences ---------------------------------------------------------------------------------


def match_occurrences(occurrences: DataFrame, projects: DataFrame) -> DataFrame:
    """Each unlinked occurrence with the project it names, or why it names none.

    Candidates share the normalised name; a shared commodity narrows several unless it leaves
    none; a region contained in the project's region narrows several only to exactly one.

    No candidate pairs are produced: both sides are reduced to distinct profiles (name,
    commodities, region) with counts, profiles are compared, and the verdict is joined back. A
    name carried by very many projects costs its number of distinct profiles.
    """
    array = F.array().cast("array<string>")
    held = F.array_sort(F.array_distinct(F.coalesce("commodities", array)))
    region = F.lower(F.coalesce("region", F.lit("")))
    profile = projects.groupBy(N.project_key("name").alias("key"), held.alias("p_comm"), region.alias("p_region")).agg(
        F.count("*").alias("n"), F.min("project_id").alias("id")
    )
    rows = occurrences.select("*", N.project_key("name").alias("key"), held.alias("o_comm"), region.alias("o_region"))
    asked = rows.select("key", "o_comm", "o_region").distinct()
    met = asked.join(profile, "key", "left")
    present = F.col("n").isNotNull()
    shares = present & F.arrays_overlap("p_comm", "o_comm")
    inside = present & (F.col("o_region") != "") & F.contains(F.col("p_region"), F.col("o_region"))

    def tally(condition: Column, name: str) -> list[Column]:
        return [
            F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(f"n_{name}"),
            F.min(F.when(condition, F.col("id"))).alias(f"id_{name}"),
        ]

    counted = met.groupBy("key", "o_comm", "o_region").agg(
        *tally(present, "all"), *tally(F.coalesce(shares, F.lit(False)), "comm"), *tally(inside, "region"),
        *tally(inside & F.coalesce(shares, F.lit(False)), "both"),
    )
    by_commodity = (F.size("o_comm") > 0) & (F.col("n_all") > 1) & (F.col("n_comm") > 0)
    n1 = F.when(by_commodity, F.col("n_comm")).otherwise(F.col("n_all"))
    id1 = F.when(by_commodity, F.col("id_comm")).otherwise(F.col("id_all"))
    n2 = F.when(by_commodity, F.col("n_both")).otherwise(F.col("n_region"))
    id2 = F.when(by_commodity, F.col("id_both")).otherwise(F.col("id_region"))
    by_region = (F.col("o_region") != "") & (n1 > 1) & (n2 == 1)
    final_n = F.when(by_region, F.lit(1)).otherwise(n1)
    verdict = counted.select(
        "key", "o_comm", "o_region",
        F.when(final_n == 1, F.when(by_region, id2).otherwise(id1)).alias("project_id"),
        F.when(final_n == 0, F.lit("none")).when(final_n > 1, F.lit("ambiguous")).otherwise(F.lit("linked")).alias("outcome"),
    )
    base = [c for c in occurrences.columns if c != "project_id"]
    return rows.join(verdict, ["key", "o_comm", "o_region"], "left").select(*[rows[c] for c in base], verdict["project_id"], verdict["outcome"])


def fill_coordinates(projects: DataFrame, matched: DataFrame) -> DataFrame:
    """Coordinates from a linked occurrence, only where a project has neither."""
    first = matched.filter(F.col("outcome") == "linked").groupBy("project_id").agg(
        F.min_by(F.struct("lat", "lng"), "occurrence_id").alias("_at")
    )
    empty = F.col("lat").isNull() & F.col("lng").isNull()
    joined = projects.join(first, "project_id", "left")
    changed = {c: F.when(empty, F.col(f"_at.{c}")).otherwise(F.col(c)) for c in ("lat", "lng")}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in projects.columns])


def apply_manual_links(rows: DataFrame, decisions: DataFrame, key: str, targets: tuple[str, ...]) -> DataFrame:
    """Manual links: a decision's ids fill or replace the stored ones; null leaves them."""
    new = decisions.select(key, *[F.col(t).alias(f"_{t}") for t in targets])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in targets else F.col(c) for c in rows.columns])


# --- archive files against the filing index -----------------------------------------------------


def size_bucket(kb: Column) -> Column:
    """Coarse size class: linear while the tolerance is flat, geometric once it grows."""
    return F.when(kb < 400, F.floor(kb / 4)).otherwise(100 + F.floor(F.log(kb / 400) / 0.01)).cast("long")


def match_files(files: DataFrame, index: DataFrame) -> DataFrame:
    """Each archive file with the one index row it can be, or null.

    Equal document name, equal party (profile number where both sides have one, else company
    name) and a size within max(2 kB, 0.5 %). Only accepted when all candidates share one (date,
    time, size); a candidate under the file's own company name is preferred.

    The tolerance becomes an equality join on size classes: an index row is listed under each
    class its band touches. Files are reduced to distinct signatures before and matched once.
    """
    sides = files.select("*", plain_name("document").alias("doc"), profile_digits("profile_number").alias("number"), plain_name("company").alias("party"))
    asked = sides.select("doc", "number", "party", "size_bytes").distinct().withColumn("kb", F.col("size_bytes") / 1024)
    asked = asked.withColumn("bucket", size_bucket(F.col("kb")))
    rows = index.select(
        plain_name("document").alias("doc"), profile_digits("profile_number").alias("i_number"), plain_name("profile_name").alias("i_party"),
        "profile_name", "profile_number", "submitted_date", "submitted_time", "file_size_kb",
    ).distinct()
    slack = F.greatest(F.lit(2.0), F.lit(0.005) * F.col("file_size_kb"))
    low, high = size_bucket(F.greatest(F.lit(0.0), F.col("file_size_kb") - slack)), size_bucket(F.col("file_size_kb") + slack)
    listed = rows.withColumn("slack", slack).withColumn("bucket", F.explode(F.sequence(low, high)))
    near = F.abs(F.col("file_size_kb") - F.col("kb")) <= F.col("slack")
    both = (F.col("i_number") != "") & (F.col("number") != "")
    # one list of marks a side, by number and by name, so that each side is cut and reduced once
    marks = lambda number, party: F.explode(F.array_compact(F.array(
        F.when(F.col(number) != "", F.concat(F.lit("n"), number)), F.concat(F.lit("p"), party)
    ))).alias("mark")
    met = listed.select("*", marks("i_number", "i_party")).join(asked.select("*", marks("number", "party")), ["doc", "bucket", "mark"])
    pairs = met.filter(near & (F.col("mark").startswith("n") | ~both))
    when = F.struct("submitted_date", "submitted_time", "file_size_kb")
    own_name = F.when(F.col("i_party") == F.col("party"), F.lit(0)).otherwise(F.lit(1))
    settled = pairs.groupBy("doc", "number", "party", "size_bytes").agg(
        F.min(when).alias("first"), F.max(when).alias("last"),
        F.min_by(F.struct("profile_name", "profile_number", "submitted_date", "submitted_time"), F.struct(own_name, "profile_name", "profile_number")).alias("row"),
    )
    unique = settled.filter(F.col("first") == F.col("last")).select(
        "doc", "number", "party", "size_bytes", F.col("row.profile_name").alias("matched_name"), F.col("row.profile_number").alias("matched_number"),
        F.col("row.submitted_date").alias("submitted_date"), F.col("row.submitted_time").alias("submitted_time"),
    )
    return sides.join(unique, ["doc", "number", "party", "size_bytes"], "left").drop("doc", "number", "party")


def repair_dates(filings: DataFrame, matched: DataFrame) -> DataFrame:
    """Filing dates filled from a match, only when missing and not after the ingest day."""
    found = matched.filter(F.col("submitted_date").isNotNull()).groupBy("document_id").agg(F.min("submitted_date").alias("_d"))
    fits = F.col("filed_at").isNull() & (F.col("_d") <= F.to_date("created_at"))
    joined = filings.join(found, "document_id", "left")
    repaired = joined.withColumn("date_repaired", F.coalesce(fits, F.lit(False)))
    return repaired.withColumn("filed_at", F.when(F.col("date_repaired"), F.col("_d")).otherwise(F.col("filed_at"))).drop("_d")


def archive_stats(matched: DataFrame) -> DataFrame:
    """Per archive: files, matches, misses, French copies, files known before and the date span."""
    french = F.lower("document").contains("french")
    fresh = ~french & ~F.col("known")
    hit = F.col("submitted_date").isNotNull()
    return matched.groupBy("archive").agg(
        F.count("*").alias("pdfs"),
        F.count_if(fresh & hit).alias("matched"),
        F.count_if(fresh & ~hit).alias("unmatched"),
        F.count_if(french).alias("french"),
        F.count_if(~french & F.col("known")).alias("in_db"),
        F.min(F.when(~french, F.col("submitted_date"))).alias("first_date"),
        F.max(F.when(~french, F.col("submitted_date"))).alias("last_date"),
    )


def unmatched_files(matched: DataFrame) -> DataFrame:
    """The files behind the count of misses: new, not French, and without one sure row in the index."""
    fresh = ~F.lower("document").contains("french") & ~F.col("known")
    return matched.filter(fresh & F.col("submitted_date").isNull()).select("archive", "document_id", "document", "company", "size_bytes")


def upsert_occurrences(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge occurrences by (source, external id); a stored project link is kept.

    Of several rows of one id the last by ``position`` wins.
    """
    one = last_per_key(incoming, ["source", "external_id"], F.col("position")).drop("position")
    return upsert(stored, one, ["source", "external_id"], overwrite=["name", "lat", "lng"], fill=["country", "region", "commodities"])
