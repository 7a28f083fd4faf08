"""Licence scans by canonical digest.

A text is brought to a canonical form: lower case, equivalent spellings made one, every run of other characters than
letters and digits one space, and copyright statements left out. A statement is what a block, divided from others by blank
lines, begins with, from its copyright and sign or year up to the words that open a licence. So the form is one of words,
and neither the width at which a text is wrapped nor its kind of line ends changes it. The digest of the canonical form is
joined with the digests of known licence texts, which went through the same form. Whole documents are looked up as they
are, and every line of a document as a text of its own, which finds licence notices inside other text. Known texts of more
lines are found inside other text as runs of blocks: blocks equal to the first block of a known text are candidates, and
the blocks after them are compared by digest. Overlapping texts (a licence that quotes its notice) count each.

Nulls and odd input: a null, empty or blank text has no digest and no licence; every row is looked up by itself, so
repeated rows and null ids are fine; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, text_of

#: Spellings that licence matching treats as one (left is replaced by right), whole words.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization",
    "authorised": "authorized", "favour": "favor", "whilst": "while", "judgement": "judgment",
    "noncommercial": "non commercial", "percent": "per cent", "https": "http",
}
#: How a copyright statement begins, and the words that open a licence behind one, in canonical form.
STATEMENT = r"^(?:c )?(?:copyright (?:c |[0-9]|the |by )|c [0-9]{4} |c all$|all rights reserved$)"
OPENING = r"(permission is |permission to |redistribution and use |everyone is permitted |licensed under |released under |this (?:program|software|source|file|work|library) )"
#: Licence notices and short licences.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)


#: Files of ``license_texts``: whole licences, their standard headers and spellings, named by what stands before the plus.
FILES = (
    "0BSD", "Apache-2.0", "Apache-2.0+header", "BSD-2-Clause", "BSD-2-Clause+1", "BSD-3-Clause", "BSD-3-Clause+1", "BSD-3-Clause+2", "BSD-3-Clause+3", "CC0-1.0", "GPL-2.0",
    "GPL-2.0+header",
    "GPL-3.0", "GPL-3.0+header", "LGPL-2.1", "LGPL-3.0", "MIT", "MIT+1", "MIT+2", "MPL-2.0", "MPL-2.0+header", "Unlicense", "Zlib",
)


def file_texts() -> list[tuple[str, str]]:
    return [(name.split("+")[0], pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()) for name in FILES]


def known_licenses(spark: SparkSession) -> DataFrame:
    """``license_id, text`` of the texts above; a caller may pass a larger table of the same columns."""
    rows = F.array(*[F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in (*KNOWN, *file_texts())])
    return spark.range(1).select(F.inline(rows))


def canonical(text: Column) -> Column:
    """The words of a text in canonical form, without a copyright statement at its start."""
    plain = F.btrim(F.regexp_replace(F.replace(F.lower(text), F.lit("©"), F.lit(" c ")), r"[^\p{L}\p{N}]+", " "))
    one = plain
    for spelled, as_one in SPELLINGS.items():
        one = F.regexp_replace(one, rf"\b{spelled}\b", as_one)
    words = F.when(plain.rlike(r"\b(" + "|".join(SPELLINGS) + r")\b"), one).otherwise(plain)
    opened = F.regexp_replace(words, r"^.*?" + OPENING, "$1")
    return F.when(~words.rlike(STATEMENT), words).when(words.rlike(OPENING), opened).otherwise("")


def digests(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep``, with the digest of the whole canonical text, those of its canonical lines, and digest and lines of its blocks."""
    full = lambda part: part != ""
    blocks = F.filter(F.split(text_of(F.col("`text`")), r"\n\s*\n"), lambda block: block.rlike(r"[\p{L}\p{N}]"))
    each = F.transform(blocks, lambda block: F.struct(canonical(block).alias("words"), F.filter(F.transform(F.split(block, "\n"), canonical), full).alias("lines")))
    rows = texts.select(*keep, F.filter(each, lambda block: block["words"] != "").alias("blocks"))
    whole = F.when(F.size("blocks") > 0, F.md5(F.array_join("blocks.words", " ")))
    lines = F.transform(F.flatten("blocks.lines"), lambda line: F.md5(line))
    short = F.transform("blocks", lambda block: F.struct(F.md5(block["words"]).alias("digest"), F.size(block["lines"]).alias("n")))
    return rows.select(*keep, whole.alias("digest"), lines.alias("line_digests"), short.alias("blocks"))


def scanned(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, digest, license_id, n_notices, licenses``: the licence that the whole text is, and those stated inside it."""
    spark = docs.sparkSession
    known = known_licenses(spark) if known is None else known
    tables = Written(spark, "licenses")
    texts = tables.keep(digests(known, "license_id").filter("digest IS NOT NULL"), "known")
    names = texts.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    runs = texts.groupBy(F.col("blocks.digest").alias("run")).agg(F.min("license_id").alias("license_id"))
    runs = runs.select(F.col("run")[0].alias("digest"), "run", "license_id")
    rows = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    rows = tables.keep(digests(rows, "doc_id").withColumn("row", F.monotonically_increasing_id()), "digests")
    lines = rows.select("row", F.explode("line_digests").alias("digest")).join(names, "digest").select("row", "license_id")
    # few blocks begin a known text, and only these meet the blocks of their row again; a block of one line counts as a line
    begins = rows.select("row", F.posexplode("blocks").alias("at", "block")).select("row", "at", F.col("block.n").alias("n"), F.col("block.digest").alias("digest"))
    begins = begins.join(runs, "digest").filter("n > 1 OR size(run) > 1").select("row", "at", "run", "license_id")
    same = F.slice("blocks.digest", F.col("at") + 1, F.size("run")) == F.col("run")
    inside = begins.join(rows.select("row", "blocks"), "row").filter(same).select("row", "license_id")
    found = lines.unionByName(inside).groupBy("row").agg(F.count("*").alias("n_notices"), F.array_sort(F.collect_set("license_id")).alias("licenses"))
    whole = rows.select("row", "doc_id", "digest").join(names, "digest", "left").join(found, "row", "left")
    return whole.select("doc_id", "digest", "license_id", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.array_join("licenses", ",").alias("licenses"))
