"""Checking extracted figures against source text, and the review queue.

Figures meet text through an index of printed numbers: numbers are lifted out of chunks once,
facts list the forms their key figure can be printed in, and the two join on equality. No fact
is tried against every chunk of its document. Facts and chunks are dealt by document once; all
that follows keeps them there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.columns import ColumnLike, col
from ..functions.text import is_contents_page
from .keyed import deal, joined_where_dealt

# A printed number: digit groups joined by single separators, taken as long as they go. Nothing is given back, so long lists need no deep stack.
NUMBER = r"(?<![\d.,])\d++(?:[.,]\d++)*+(?![\d]|[.,]\d)"


def _texts(value: ColumnLike, scales: tuple[float, ...], min_digits: int) -> Column:
    """A positive figure with commas and up to three decimals, all ways in one string with bars between."""
    texts, least = [], 10 ** (min_digits - 1)
    for scale in scales:
        v = col(value) * F.lit(scale)
        for decimals in range(4):
            text, shown = F.format_number(v, decimals), v > 0
            if decimals == 0:
                shown = shown & (F.abs(v - F.rint(v)) <= 1e-9)
            if min_digits <= 1:
                texts.append(F.when(shown, text))
            else:
                # digits are counted in the text only where rounding decides
                units = v * F.lit(float(10**decimals))
                texts.append(F.when(shown & (units >= least), text).when(shown & (units > least - 1) & (digits(text) >= min_digits), text))
    return F.concat_ws("|", *texts)


def _grouped(texts: Column) -> Column:
    """The texts with commas, without, and with blanks for them."""
    return F.concat_ws("|", texts, F.replace(texts, F.lit(","), F.lit("")), F.replace(texts, F.lit(","), F.lit(" ")))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def printed_text(value: ColumnLike, scales: tuple[float, ...] = (1.0,), min_digits: int = 1) -> Column:
    """The forms of ``printed_forms`` in one string with bars between; some may come twice, and bars may follow each other."""
    return _grouped(_texts(value, scales, min_digits))


def printed_forms(value: ColumnLike, scales: tuple[float, ...] = (1.0,), min_digits: int = 1) -> Column:
    """Every way a positive figure can be printed: up to three decimals, three groupings."""
    return F.array_remove(F.array_distinct(F.split(_once(_texts(value, scales, min_digits), _grouped), r"\|")), "")


def digits(form: Column) -> Column:
    """Significant digits: separators and leading zeros do not count."""
    return F.length(F.ltrim(F.translate(form, "., ", ""), F.lit("0")))


def prints(window: Column, value: ColumnLike, scales: tuple[float, ...] = (1.0,), min_digits: int = 1) -> Column:
    """Whether a text window prints a figure in any form, on number boundaries.

    The numbers of the window are read once and compared as text; only forms grouped by blanks,
    which large figures alone have, are searched for one by one.
    """
    numbers = F.regexp_extract_all(window, F.lit(NUMBER), F.lit(0))
    pattern = lambda f: F.concat(F.lit(r"(?<![\d.,])"), F.replace(f, F.lit("."), F.lit(r"\.")), F.lit(r"(?![\d]|[.,]\d)"))
    blanked = lambda forms: F.exists(forms, lambda f: f.contains(" ") & F.regexp_like(window, pattern(f)))
    return _once(
        _texts(value, scales, min_digits), lambda t: _once(F.split(_grouped(t), r"\|"), lambda forms: F.arrays_overlap(numbers, forms) | (t.contains(",") & blanked(forms)))
    )


def by_document(*tables: DataFrame) -> list[DataFrame]:
    """Tables dealt by document, where joins and groups within a document find their rows without another shuffle."""
    return deal("document_id", *tables)


def chunk_numbers(chunks: DataFrame, min_digits: int = 1) -> DataFrame:
    """(document_id, chunk_id, number) of every number printed in a chunk, once each.

    Those with fewer significant digits than asked for are left out, unless groups set off by blanks may go on from them.
    """
    pattern = NUMBER
    if min_digits > 1:
        enough = r"(?=[0.,]*+\d(?:[.,]?\d){%d}|\d{1,3} \d{3})" % (min_digits - 1)
        pattern = NUMBER.replace(r"\d++", enough + r"\d++", 1)
    numbers = F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)))
    return chunks.select("document_id", "chunk_id", F.explode(numbers).alias("number"))


def number_places(content: ColumnLike, number: ColumnLike) -> Column:
    """Positions, from 0, where a text prints just this number."""
    text, number = col(content), col(number)
    first = F.instr(text, number)
    ends = lambda at: ~F.substring(text, at + F.length(number), F.lit(2)).rlike(r"^(\d|[.,]\d)")
    starts = (first == 1) | ~F.lit("0123456789.,").contains(F.substring(text, first - 1, F.lit(1)))
    gaps = F.split(text, F.concat(F.lit(r"(?<![\d.,])\Q"), number, F.lit(r"\E(?!\d|[.,]\d)")))

    def step(state: Column, gap: Column) -> Column:
        here = state["at"] + F.length(gap)
        return F.struct((here + F.length(number)).alias("at"), F.concat(state["found"], F.array(here)).alias("found"))

    none = F.array().cast("array<int>")
    several = F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda state: state["found"])
    # most numbers stand in a text once, which needs no pattern
    alone = F.position(number, text, first + 1) == 0
    return F.when(first == 0, none).when(alone, F.when(starts & ends(first), F.array(first - 1)).otherwise(none)).otherwise(several)


def soft_text(chunks: DataFrame) -> DataFrame:
    """Chunks with hard blanks softened."""
    return chunks.withColumn("content", F.replace(F.col("content"), F.lit("\u00a0"), F.lit(" ")))


def readable_chunks(chunks: DataFrame, facts: DataFrame | None = None, drop_contents: bool = True) -> DataFrame:
    """Chunks, of documents that have facts to check if these are given, hard blanks softened, contents pages out."""
    rows = soft_text(chunks if facts is None else chunks.join(facts.select("document_id").distinct(), "document_id", "left_semi"))
    return rows.filter(~is_contents_page("content")) if drop_contents else rows


def _lead(number: Column) -> Column:
    """The first three significant digits: the same for all ways to print a figure, but for rounding."""
    bare = F.replace(F.replace(number, F.lit(","), F.lit("")), F.lit("."), F.lit(""))
    return F.left(F.ltrim(bare, F.lit("0")), F.lit(3))


def _leads(forms: Column) -> Column:
    """Leads of the first digit groups of all forms, given with bars between, each once."""
    bare = F.replace(F.replace(forms, F.lit(","), F.lit("")), F.lit("."), F.lit(""))
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?:^|\|)0*+([0-9]{0,3})"), F.lit(1)))


def figure_hits(anchors: DataFrame, chunks: DataFrame, texts: DataFrame | None = None, min_digits: int = 1) -> DataFrame:
    """Where anchor figures are printed: what ``anchors`` hold but for the forms, chunk_id, pos and the chunk's text.

    ``anchors`` holds fact_id, document_id, forms, as a list or as ``printed_text`` and of at least ``min_digits``, and what else a hit is to carry;
    ``texts`` the text of each chunk, where it is to be had for less than ``chunks``. Facts meet numbers on leading digits, of which a figure has a
    few where it has dozens of forms; the number, or the first digit group of a form printed with blanks, is compared next and then the whole form.
    Every join is inside a document: tables dealt by document are not shuffled.
    """
    kept = [c for c in anchors.columns if c != "forms"]
    if anchors.schema["forms"].dataType.simpleString() != "string":
        anchors = anchors.withColumn("forms", F.array_join("forms", "|"))
    keyed = anchors.select("*", F.explode(_leads(F.col("forms"))).alias("lead"))
    spots = chunk_numbers(chunks, min_digits).withColumn("lead", _lead(F.col("number")))
    listed = lambda after: F.instr(F.concat(F.lit("|"), "forms", F.lit("|")), F.concat(F.lit("|"), "number", F.lit(after))) > 0
    whole, begun = listed("|"), listed(" ")
    met = joined_where_dealt(spots, keyed, ["document_id", "lead"]).filter(whole | begun).drop("lead")
    content = (chunks if texts is None else texts).select("document_id", "chunk_id", "content")
    found = joined_where_dealt(met, content, ["document_id", "chunk_id"]).withColumn("_places", number_places("content", "number"))
    placed = found.select(*kept, "chunk_id", F.explode("_places").alias("pos"), "content", "forms", "number")

    def printed(form: Column) -> Column:
        here = F.substring(F.col("content"), F.col("pos") + 1, F.length(form)) == form
        after = F.substring(F.col("content"), F.col("pos") + F.length(form) + 1, F.lit(2))
        return form.startswith(F.concat("number", F.lit(" "))) & here & ~after.rlike(r"^(\d|[.,]\d)")

    return placed.filter(whole | (begun & F.exists(F.split("forms", r"\|"), printed))).drop("forms", "number")


def _around(before: int, after: int) -> Column:
    start = F.greatest(F.lit(0), F.col("pos") - before)
    return F.substring(F.col("content"), start + 1, F.col("pos") + after - start)


def grade_plausible(key: Column, value: Column) -> Column:
    metal = F.substring_index(key, "_", 1)
    unit = F.substring(key, F.length(metal) + 2, F.length(key))
    ceiling = F.when(unit == "gpt", F.lit(V.GRADE_SANE_MAX["gpt"])).when(unit == "pct", F.lit(V.GRADE_SANE_MAX["pct"])).when(
        unit == "ppm", F.lit(V.GRADE_SANE_MAX["ppm"])
    ).otherwise(F.lit(float("inf")))
    return value <= F.when((metal == "Ag") & (unit == "gpt"), F.lit(V.SILVER_SANE_MAX)).otherwise(ceiling)


def contained_consistent(tonnes: ColumnLike, grade: ColumnLike, metal: ColumnLike) -> Column:
    """Stored contained metal must follow from tonnes x grade within three per cent."""
    t, grades = F.coalesce(col(tonnes), F.lit(0.0)), col(grade)

    def fits(entry: Column) -> Column:
        name, unit = F.substring_index(entry["key"], "_", 1), F.regexp_replace(entry["key"], "^[^_]*_?", "")
        gpt = F.try_element_at(grades, F.concat(name, F.lit("_gpt")))
        pct = F.try_element_at(grades, F.concat(name, F.lit("_pct")))
        by_gpt = gpt.isNotNull() & unit.isin("oz", "koz", "Moz")
        by_pct = pct.isNotNull() & unit.isin("lb", "klb", "Mlb", "t", "kt", "Mt")
        pounds = F.when(unit.contains("lb"), F.lit(V.POUNDS_PER_TONNE)).otherwise(F.lit(1.0))
        expect = F.when(by_gpt, t * gpt / V.GRAMS_PER_OUNCE).when(by_pct, t * pct / 100 * pounds)
        scale = F.when(unit.startswith("k"), F.lit(1e3)).when(unit.startswith("M"), F.lit(1e6)).otherwise(F.lit(1.0))
        off = F.abs(entry["value"] * scale - expect) > V.CONTAINED_TOLERANCE * F.greatest(expect, F.lit(1.0))
        return ~F.coalesce((entry["value"] > 0) & off, F.lit(False))

    entries = F.coalesce(F.map_entries(col(metal)), F.array().cast("array<struct<key:string,value:double>>"))
    return F.forall(entries, fits)


def class_near(category: Column, window: Column) -> Column:
    """Whether a window names the class, which is given in lower case."""
    rule = F.lit(False)
    for name, pattern in V.CLASS_NEAR.items():
        rule = F.when(category == name, window.rlike("(?i)" + pattern)).otherwise(rule)
    return rule


def to_review(facts: DataFrame) -> DataFrame:
    """Facts that no one has signed off; the others are not checked again."""
    return facts.filter(~F.coalesce("reviewed", F.lit(False))) if "reviewed" in facts.columns else facts


def verify_resources(facts: DataFrame, chunks: DataFrame, dealt: bool = False) -> DataFrame:
    """(document_id, fact_id, verified) of the facts to review: tonnes, class word and every grade printed together.

    ``dealt`` says that both tables come dealt by document.
    """
    facts, chunks = (to_review(facts), chunks) if dealt else by_document(to_review(facts), chunks)
    grades = F.coalesce(F.map_entries("grade"), F.array().cast("array<struct<key:string,value:double>>"))
    sane = F.forall(grades, lambda e: grade_plausible(e["key"], e["value"])) & contained_consistent("tonnes", "grade", "contained_metal")
    forms = printed_text("tonnes", V.FIGURE_SCALES, 3)
    anchors = facts.filter(sane).select("fact_id", "document_id", F.lower("category").alias("category"), "grade", forms.alias("forms"))
    readable = readable_chunks(chunks, None if dealt else facts)
    hits = figure_hits(anchors, readable, soft_text(chunks), 3)
    window = _around(0, V.FIGURE_WINDOW)
    has_grades = F.size(F.coalesce(F.col("grade"), F.create_map().cast("map<string,double>"))) > 0
    printed = F.forall(F.map_values("grade"), lambda g: prints(window, g))
    alone = digits(F.regexp_replace(F.left(window, F.lit(12)), r"\D", "")) >= 3
    good = class_near(F.col("category"), _around(*V.CLASS_WINDOW)) & F.when(has_grades, printed).otherwise(alone)
    return _verdicts(facts, hits.filter(good))


def verify_economics(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, fact_id, verified) of the facts to review: a labelled value with the rate of return or the capital near it."""
    facts, chunks = by_document(to_review(facts), chunks)
    values = F.coalesce(F.map_values("npv"), F.array().cast("array<double>"))
    forms = F.array_distinct(F.flatten(F.transform(values, lambda v: printed_forms(v, (1.0,), 3))))
    anchors = facts.select("fact_id", "document_id", "irr_pct", "capex_initial", forms.alias("forms"))
    hits = figure_hits(anchors, readable_chunks(chunks, facts), soft_text(chunks), min_digits=3)
    labelled = _around(150, 0).rlike("(?i)NPV")
    near = _around(600, 600)
    others = F.array_compact(F.array("irr_pct", "capex_initial"))
    good = labelled & ((F.size(others) == 0) | F.exists(others, lambda o: prints(near, o)))
    return _verdicts(facts, hits.filter(good))


HOLES_PER_SLICE = 500


def verify_drills(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, fact_id, verified) of the facts to review: the hole id followed by interval, from and one of the assays.

    Hole ids of a document travel with its chunks in slices of bounded size and are looked up
    inside the expression, so only holes a chunk really names become rows.
    """
    facts = to_review(facts)
    named = facts.filter(F.length(F.regexp_replace(F.lower("hole_id"), "[^a-z0-9]", "")) >= 3)
    holes = named.select("document_id", "hole_id").distinct()
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("hole_id")) - 1
    slices = holes.withColumn("slice", F.floor(number / HOLES_PER_SLICE)).groupBy("document_id", "slice").agg(F.collect_list("hole_id").alias("holes"))
    text = readable_chunks(chunks, named, drop_contents=False).select("document_id", "chunk_id", "content")
    lower = F.lower("content")
    seen = text.join(slices, "document_id").select(
        "document_id", "content", F.explode(F.filter("holes", lambda h: F.contains(lower, F.lower(h)))).alias("hole_id")
    )
    after = F.concat(F.lit("(?i)\\Q"), "hole_id", F.lit(r"\E(?=([\s\S]{0," + str(V.FIGURE_WINDOW) + "}))"))
    windows = seen.select("document_id", "hole_id", F.explode(F.regexp_extract_all("content", after, F.lit(1))).alias("window"))
    met = windows.join(named.select("fact_id", "document_id", "hole_id", "interval_m", "from_m", "assays"), ["document_id", "hole_id"])
    window = F.col("window")
    assays = F.coalesce(F.map_values("assays"), F.array().cast("array<double>"))
    good = (
        prints(window, "interval_m", min_digits=2)
        & (F.col("from_m").isNull() | prints(window, "from_m"))
        & ((F.size(assays) == 0) | F.exists(assays, lambda a: prints(window, a)))
    )
    return _verdicts(facts, met.filter(good))


def _verdicts(facts: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per fact row; facts and hits are counted together by document and fact."""
    marked = lambda t, hit: t.select("document_id", "fact_id", F.lit(hit).alias("hit"))
    both = marked(facts, False).union(marked(hits.filter(F.col("fact_id").isNotNull()), True))
    counted = both.groupBy("document_id", "fact_id").agg(F.max("hit").alias("verified"), F.count_if(~F.col("hit")).cast("int").alias("n"))
    return counted.select("document_id", "fact_id", "verified", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("_")).drop("_")


def apply_verdicts(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Facts with verified rows signed off; reviewed rows stay as they are. Verdicts that name the document are met where it is dealt."""
    if "document_id" in verdicts.columns:
        rows = facts.withColumns({"verified": F.lit(None).cast("boolean"), "_fact": F.lit(True)})
        both = rows.unionByName(verdicts.select("document_id", "fact_id", "verified").withColumn("_fact", F.lit(False)), allowMissingColumns=True)
        joined = both.withColumn("verified", F.max("verified").over(Window.partitionBy("document_id", "fact_id"))).filter("_fact").drop("_fact")
    else:
        joined = facts.join(verdicts, "fact_id", "left")
    passed = F.coalesce("verified", F.lit(False)) & ~F.col("reviewed")
    stored = lambda c: F.col(c) if c in facts.columns else F.lit(None).cast("string")
    return joined.withColumns(
        {
            "review_source": F.when(passed, F.lit(V.AUTO_SOURCE)).otherwise(stored("review_source")),
            "review_note": F.when(passed, F.lit(V.AUTO_NOTE)).otherwise(stored("review_note")),
            "reviewed": F.col("reviewed") | passed,
        }
    ).drop("verified")


def verdict_counts(kinds: dict[str, DataFrame]) -> DataFrame:
    parts = [v.select(F.lit(k).alias("kind"), "verified") for k, v in kinds.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("kind").agg(F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("to_read"))


# --- decisions ---------------------------------------------------------------------------------


def apply_decisions(facts: DataFrame, decisions: DataFrame, kind: str, source: str = "human") -> DataFrame:
    """Facts after approve, edit and delete decisions of one kind.

    Already reviewed rows are left alone, and so of several decisions on a row the first by ``seq`` counts. Edits are text cast to the stored type; a decision
    naming a field that may not be edited changes nothing.
    """
    editable = V.EDITABLE_FIELDS[kind]
    rows = decisions.filter(F.col("kind") == kind).withColumn("_fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
    allowed = F.array(*[F.lit(f) for f in editable])
    rows = rows.filter(F.forall(F.map_keys("_fields"), lambda k: F.array_contains(allowed, k)))
    one = rows.groupBy(F.col("id").alias("fact_id")).agg(F.min_by(F.struct("action", "_fields", "note"), "seq").alias("_d"))
    joined = facts.join(one, "fact_id", "left")
    active = F.col("_d").isNotNull() & ~F.col("reviewed")
    kept = joined.filter(~F.coalesce(active & F.col("_d.action").isin("delete", "reject"), F.lit(False)))
    signed = active & F.col("_d.action").isin("approve", "edit")
    types = {f.name: f.dataType for f in facts.schema.fields}
    columns = []
    for name in facts.columns:
        stored = F.col(name)
        if name in editable and not types[name].simpleString().startswith("map"):
            change = F.try_element_at(F.col("_d._fields"), F.lit(name))
            stored = F.when(signed & change.isNotNull(), change.try_cast(types[name])).otherwise(stored)
        elif name in editable:
            change = F.from_json(F.try_element_at(F.col("_d._fields"), F.lit(name)), types[name].simpleString())
            stored = F.when(signed & change.isNotNull(), change).otherwise(stored)
        elif name == "reviewed":
            stored = F.coalesce(signed, F.lit(False)) | stored
        columns.append(stored.alias(name))
    note = F.when(signed, F.left(F.coalesce("_d.note", F.lit("")), F.lit(500)))
    return kept.select(*columns, F.when(signed, F.lit(source)).alias("review_source"), note.alias("review_note"))


def decision_counts(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """How decisions land: approve, edit, delete, or skipped because reviewed, gone or decided before."""
    state = facts.select(F.col("fact_id").alias("id"), "kind", "reviewed")
    counts = decisions.groupBy("kind", "id").agg(F.min("seq").alias("_first"))
    joined = decisions.join(counts, ["kind", "id"]).join(state, ["kind", "id"], "left")
    edited = F.size(F.coalesce("fields", F.create_map().cast("map<string,string>"))) > 0
    outcome = (
        F.when(F.col("reviewed").isNull() | F.col("reviewed") | (F.col("seq") > F.col("_first")), F.lit("skipped"))
        .when(F.col("action").isin("delete", "reject"), F.lit("delete"))
        .when(edited, F.lit("edit"))
        .otherwise(F.lit("approve"))
    )
    return joined.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def bulk_approve(facts: DataFrame, least: float = V.TRUSTED_CONFIDENCE) -> DataFrame:
    good = ~F.col("reviewed") & (F.col("extraction_confidence") >= least)
    good = F.coalesce(good, F.lit(False))
    before = F.col("review_source") if "review_source" in facts.columns else F.lit(None).cast("string")
    return facts.withColumns({"review_source": F.when(good, F.lit("human")).otherwise(before), "reviewed": F.col("reviewed") | good})


# --- queue -------------------------------------------------------------------------------------


def low_confidence_documents(resources: DataFrame, economics: DataFrame, below: float = V.TRUSTED_CONFIDENCE) -> DataFrame:
    weak = lambda t: t.filter(~F.col("reviewed") & (F.col("extraction_confidence") < below)).select("document_id")
    return weak(resources).union(weak(economics)).distinct()


def review_queue(resources: DataFrame, economics: DataFrame, drills: DataFrame, projects: DataFrame, per_table: int = 100) -> DataFrame:
    """The least certain unreviewed rows of each table, then one order over all of them.

    Rows without a confidence come first inside their table and last in the common order.
    """
    text = lambda c, missing: F.coalesce(F.col(c).cast("string"), F.lit(missing))
    kinds = (
        ("resource", resources, "estimate_id", F.concat(text("category", "resource"), F.lit(" · "), text("tonnes", "?"), F.lit(" t"))),
        ("economics", economics, "study_id", F.concat(text("study_type", "study"), F.lit(" · IRR "), text("irr_pct", V.DASH), F.lit("%"))),
        ("drill", drills, "drill_id", F.concat(text("hole_id", "hole"), F.lit(" · "), text("interval_m", V.DASH), F.lit(" m"))),
    )
    names = projects.select("project_id", F.col("name").alias("project_name"))
    queue = None
    for kind, table, key, label in kinds:
        rows = table.filter(~F.col("reviewed")).select(
            F.lit(kind).alias("kind"), F.col(key).cast("string").alias("fact_id"), "project_id", "document_id", "extraction_confidence", label.alias("label")
        )
        rows = rows.join(names, "project_id").orderBy(F.col("extraction_confidence").asc_nulls_first(), "fact_id").limit(per_table)
        queue = rows if queue is None else queue.unionByName(rows)
    attention = F.coalesce("extraction_confidence", F.lit(0.0)) < V.LOW_CONFIDENCE
    return queue.withColumn("attention", attention).orderBy(F.coalesce("extraction_confidence", F.lit(1.0)), "kind", "fact_id")


def review_queue_size(resources: DataFrame, economics: DataFrame, drills: DataFrame) -> DataFrame:
    parts = [t.filter(~F.col("reviewed")).agg(F.count("*").alias("n")) for t in (resources, economics, drills)]
    return parts[0].union(parts[1]).union(parts[2]).agg(F.sum("n").alias("n"))


def review_packets(
    anchors: DataFrame, holes: DataFrame, chunks: DataFrame, budget: int = V.PACKET_BUDGET, dealt: bool = False, min_digits: int = 1
) -> DataFrame:
    """Chunks to read per document: those printing an anchor figure or naming a hole, contents
    pages out, in order until the budget is first passed.

    ``anchors`` holds fact_id, document_id and forms of at least ``min_digits``; ``holes`` document_id and hole_id. ``dealt`` says that anchors and
    chunks come dealt by document.
    """
    holes = holes.select("document_id", "hole_id")
    if dealt:
        rows = readable_chunks(chunks)
    else:
        anchors, chunks, holes = by_document(anchors, chunks, holes)
        rows = readable_chunks(chunks, anchors.select("document_id").union(holes.select("document_id")))
    by_figure = figure_hits(anchors, rows, soft_text(chunks), min_digits).select("document_id", "chunk_id")
    sliced = holes.distinct().withColumn("slice", F.floor((F.row_number().over(Window.partitionBy("document_id").orderBy("hole_id")) - 1) / HOLES_PER_SLICE))
    lists = sliced.groupBy("document_id", "slice").agg(F.collect_list("hole_id").alias("holes"))
    by_hole = rows.join(lists, "document_id").filter(F.exists("holes", lambda h: F.contains(F.col("content"), h))).select("document_id", "chunk_id")
    hit = by_figure.union(by_hole).distinct()
    met = joined_where_dealt(rows, hit.withColumn("_hit", F.lit(True)), ["document_id", "chunk_id"]).select(*rows.columns)
    upto = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn("_run", F.sum(F.length("content")).over(upto)).filter(F.col("_run") <= budget).drop("_run")
