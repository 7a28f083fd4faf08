"""The registered query of each operator, over whole tables, with the DuckDB text it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, language, lattice, licenses, lines, minhash, mixing, packing, quality, rules, substrings, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_minhash_near_dedup")
def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.classes(table(spark, folder, "documents"))


RULES_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), again AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) AS t(k) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, (length(text) - length(replace(text, '!', '')))::BIGINT AS n_marks
  FROM w LEFT JOIN covered c USING (doc_id)
), f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN word_chars > 15 * n_words OR 2 * word_chars < 3 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END + CASE WHEN 2 * n_marks > n_words THEN 32 ELSE 0 END)::BIGINT AS failed
  FROM m
)
SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM f
"""


@query("op2_quality_rules", RULES_SQL)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judged(rules.stored(table(spark, folder, "documents")))


ABLATIONS_SQL = RULES_SQL[: RULES_SQL.rindex("SELECT *, failed & 3")].rstrip() + """, p AS (
  SELECT * FROM (VALUES ('base', 1, 3), ('full', 1, 63)) AS t(policy, version, mask)
), r AS (
  SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('word_length', 8), ('repeated_lines', 16), ('marks', 32)) AS t(rule, bit)
)
SELECT policy, version, rule, count(*) FILTER (failed & bit <> 0) AS fail, count(*) FILTER (failed & mask = bit) AS fail_alone,
       count(*) FILTER ((failed & mask) - (failed & bit) = 0) AS kept_without
FROM f, p, r WHERE mask & bit <> 0 GROUP BY ALL
"""


@query("rule_ablations", ABLATIONS_SQL)
def rule_ablations(spark: SparkSession, folder: str) -> DataFrame:
    return rules.ablations(rules.stored(table(spark, folder, "documents")), [rules.BASE, rules.FULL])


LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents
), k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l
), common AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), c AS (
  SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM c GROUP BY doc_id
"""


@query("op6_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines.drop_common_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def _canonical(text: str) -> str:
    """The operator's canonical form of a column in SQL."""
    plain = f"trim(regexp_replace(replace(lower({text}), '©', ' c '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for spelled, as_one in licenses.SPELLINGS.items():
        plain = f"regexp_replace({plain}, '\\b{spelled}\\b', '{as_one}', 'g')"
    return plain


def _opened(words: str) -> str:
    return (
        f"CASE WHEN NOT regexp_matches({words}, {_quoted(licenses.STATEMENT)}) THEN {words} "
        f"WHEN regexp_matches({words}, {_quoted(licenses.OPENING)}) THEN regexp_replace({words}, {_quoted('^.*?' + licenses.OPENING)}, '\\1') ELSE '' END"
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEXTS = (*licenses.KNOWN, *licenses.file_texts())
LICENSES_SQL = f"""
WITH k AS (
  SELECT license_id, row_number() OVER () AS rid, text
  FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in _TEXTS)}) AS t(license_id, text)
), texts AS (
  SELECT 'k' AS kind, rid, license_id, text FROM k UNION ALL SELECT 'd', doc_id, NULL, coalesce(text, '') FROM documents
), b0 AS (
  SELECT kind, rid, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS block, unnest(range(len(regexp_split_to_array(text, '\\n\\s*\\n')))) AS place FROM texts
), b1 AS (
  SELECT *, {_canonical("block")} AS plain FROM b0
), b2 AS (
  SELECT kind, rid, block, place, {_opened("plain")} AS words FROM b1
), b AS (
  SELECT *, row_number() OVER (PARTITION BY kind, rid ORDER BY place) AS nth FROM b2 WHERE words <> ''
), l0 AS (
  SELECT kind, rid, nth, unnest(string_split(block, chr(10))) AS line FROM b
), l1 AS (
  SELECT kind, rid, nth, {_canonical("line")} AS plain FROM l0
), l AS (
  SELECT kind, rid, nth, md5(words) AS digest FROM (SELECT kind, rid, nth, {_opened("plain")} AS words FROM l1) WHERE words <> ''
), n AS (
  SELECT kind, rid, nth, count(*) AS n FROM l GROUP BY ALL
), whole AS (
  SELECT kind, rid, md5(string_agg(words, ' ' ORDER BY nth)) AS digest, list(md5(words) ORDER BY nth) AS run FROM b GROUP BY kind, rid
), known AS (
  SELECT digest, min(license_id) AS license_id FROM whole JOIN k USING (rid) WHERE kind = 'k' GROUP BY digest
), runs AS (
  SELECT run, min(license_id) AS license_id FROM whole JOIN k USING (rid) WHERE kind = 'k' GROUP BY run
), hits AS (
  SELECT rid, license_id FROM l JOIN known USING (digest) WHERE kind = 'd'
  UNION ALL
  SELECT b.rid, runs.license_id FROM b JOIN runs ON md5(b.words) = runs.run[1] JOIN whole w ON w.kind = 'd' AND w.rid = b.rid
  LEFT JOIN n ON n.kind = 'd' AND n.rid = b.rid AND n.nth = b.nth
  WHERE b.kind = 'd' AND w.run[b.nth:b.nth + len(runs.run) - 1] = runs.run AND (coalesce(n.n, 0) > 1 OR len(runs.run) > 1)
), found AS (
  SELECT rid, count(*) AS n, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS names FROM hits GROUP BY rid
)
SELECT d.doc_id, w.digest, known.license_id, coalesce(found.n, 0)::BIGINT AS n_notices, found.names AS licenses
FROM documents d LEFT JOIN whole w ON w.kind = 'd' AND w.rid = d.doc_id LEFT JOIN known ON known.digest = w.digest LEFT JOIN found ON found.rid = d.doc_id
"""


@query("op3_license_scan", LICENSES_SQL)
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scanned(table(spark, folder, "documents"))


SUBSTRINGS_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)
), low AS (
  SELECT g, min(doc_id) AS low FROM win GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM win JOIN low USING (g), range(50) AS t(k) WHERE low < doc_id
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), kept AS (
  SELECT doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY each.i) FILTER (gone.i IS NULL) AS text
  FROM each LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op4_substring_dedup", SUBSTRINGS_SQL)
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = substrings.without_repeats(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query("op5_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identified(table(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string")) % 4 == 2)


@query("op7_quality_scores")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = quality.scored(table(spark, folder, "documents"), labels, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op8_exact_topk", TOPK_SQL)
def exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.nearest(table(spark, folder, "embeddings"))


@query("op9_packing")
def packing_order(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


@query("op10_mixing")
def mixing_rates(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.rated(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "domain", "confidence", "n_tokens", "rate", "copies", "target", "reached")


@query("op11_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(table(spark, folder, "documents"))


PHRASES_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]', chr(10), 'g'), chr(10))) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), g AS (
  SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) AS t(size)
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), c AS (
  SELECT *, string_split(phrase, ' ') AS words FROM f WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.size, c.f AS a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail
  FROM c, (VALUES (1), (2)) AS t(k) WHERE k < c.size
), s AS (
  SELECT cuts.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
), best AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_pairs AS (
  SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, f, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase FROM c WHERE size = 3
  ) GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN inner_pairs i ON i.lang = best.lang AND i.phrase = best.phrase
  WHERE size = 3 OR i.most IS NULL OR 100 * i.most < 50 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op12_phrase_collocations", PHRASES_SQL)
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


COSINE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT reach.u, links.w FROM reach JOIN links ON links.u = reach.w
), low AS (
  SELECT u, min(w) AS component_id FROM reach GROUP BY u
), n AS (
  SELECT u, count(*) AS n_links FROM links GROUP BY u
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN low ON low.u = vec_id LEFT JOIN n ON n.u = vec_id
"""


@query("op13_embedding_near_dedup", COSINE_SQL)
def embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_copies(table(spark, folder, "embeddings"))
