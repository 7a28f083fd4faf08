"""Mixing documents to target weights by soft membership.

A table learned from labelled rows gives every document a posterior over the domains: how often each of a number of
characters occurs under each label, and how far a row's own label is to be believed. The characters are learned too: those
that tell most about the label in a sample of the labelled rows. A document of n tokens with posterior p adds r * n * p to the domain totals when
it is taken at rate r. Projected-gradient least squares finds rates, not negative, whose expected totals match the
targets: each pass sums the totals and the tokens whose rates can still move, both as small as the number of
domains, and every document then steps along its posterior. Rates start at 1, so a document moves only as far as its
domains need. All of it is DataFrame work; the driver sees numbers per domain only.

Domains come from a label column, ``source`` where not said otherwise. A label is taken as right with probability ``trust``
and otherwise as any of the others, so text that speaks clearly for another domain moves part of a document there, and rows without a
label get what their text says. With ``trust`` 0 the text alone decides.

Nulls and odd input: rows with a null label are not learned from but are mixed; a null or blank text has no tokens, and the
prior and its label alone make its posterior; very long texts are counted whole; of equal posteriors the first label in order
names the domain, of equally telling characters the smaller one is taken; a null doc_id stays null; repeated rows get equal rates;
other columns are carried or not looked at; an empty table, or one without labels, gives rate 1.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, text_of, words_of

#: Characters that are counted, and labelled rows a domain (as expected number) in which they are looked for.
CHARACTERS, PER_DOMAIN = 20, 200
#: Characters of a text that are taken apart at a time.
PART = 10_000
#: Probability that a row's own label is right.
TRUST = 0.9
#: A label's shares are drawn towards those of all labels by as much as this many documents say: few documents of a label happen to
#: differ from others, and their own label must not be outweighed by that.
SHRINK = 200
#: A posterior is as sharp as if it rested on this many characters.
SHARPNESS = 60.0
#: Share of a domain to the power of this, brought to sum 1, is its default target.
ALPHA = 0.5
PASSES, CLOSE = 24, 1e-4
#: Steps of the fit that stand in one plan; the rates are written then, so that plans do not grow with the passes.
STEPS = 2
#: Labels that a mixture may have unless the call says more; beyond that is an error, as every label is a column of the plan.
MOST_DOMAINS = 64


def letter_counts(text: Column, letters: list[str]) -> list[Column]:
    return [(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in letters]


def telling(held: DataFrame, docs: dict[str, int], tables: Written) -> list[str]:
    """The characters that tell most about ``label`` (its mutual information with them) in a sample by hash of the labelled rows.

    ``docs`` is the number of rows under each label. Texts are taken apart in parts, so no long text is held as single characters.
    """
    share = reduce(lambda rest, x: F.when(F.col("label") == x, F.lit(PER_DOMAIN / docs[x])).otherwise(rest), docs, F.lit(0.0))
    drawn = held.filter(F.pmod("k1", F.lit(1_000_000)) < 1_000_000 * share).select("label", F.lower("text").alias("text"))
    parts = drawn.select("label", "text", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / PART).cast("int"))).alias("i"))
    parts = parts.select("label", F.explode(F.split(F.substring("text", F.col("i") * PART + 1, F.lit(PART)), "")).alias("c")).filter(F.col("c").rlike("\\S"))
    cells = tables.keep(parts.groupBy("label", "c").agg(F.count("*").cast("double").alias("n")), "cells")
    by_label = cells.groupBy("label").agg(F.sum("n").alias("of_label"))
    cells = cells.join(by_label, "label")
    known = cells.groupBy("c").agg(F.sum("n").alias("of_c"), F.collect_list(F.struct("n", "of_label")).alias("cells"))
    gain = F.aggregate("cells", F.lit(0.0), lambda a, x: a + x["n"] * F.log(x["n"] / x["of_label"]))
    ranked = known.select("c", (gain - F.col("of_c") * F.log("of_c")).alias("gain"), "of_c")
    total = cells.agg(F.sum("n").alias("n")).first()["n"] or 1.0
    # rounded, so that the order of the sums does not decide between equal ones
    rows = ranked.select("c", F.round(F.col("gain") + F.col("of_c") * F.lit(math.log(total)), 6).alias("gain"))
    return sorted(r["c"] for r in rows.orderBy(F.desc("gain"), "c").limit(CHARACTERS).collect())


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def labels_of(held: DataFrame, most_domains: int) -> dict[str, int]:
    """Rows under each label, in the order of the labels."""
    rows = held.filter("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("docs")).orderBy("label").limit(most_domains + 1).collect()
    if len(rows) > most_domains:
        raise ValueError(f"more than {most_domains} domains")
    return {r["label"]: r["docs"] for r in rows}


def learned(counted: DataFrame, docs: dict[str, int], letters: int) -> dict[str, tuple[float, list[float]]]:
    """Per label: log prior, and the log share of each letter, drawn towards the share under all labels."""
    rows = counted.filter("label IS NOT NULL").groupBy("label").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(letters)])
    found = {r["label"]: np.array([r[f"c{k}"] for k in range(letters)]) for r in rows.collect()}
    number = sum(docs.values())
    pool = sum(found.values()) + 1.0
    added = SHRINK / number * pool
    shares = {x: (counts + added) / (counts + added).sum() for x, counts in found.items()}
    return {x: (math.log(n / number), np.log(shares[x]).tolist()) for x, n in docs.items()}


def posteriors(counted: DataFrame, table: dict[str, tuple[float, list[float]]], trust: float = TRUST) -> DataFrame:
    """``k1, k2, n, p0, p1, ...``: the posterior of each domain in the order of ``table``."""
    domains = range(len(table))
    letters = [F.col(f"c{k}") for k in range(len(next(iter(table.values()))[1]))]
    total = F.greatest(F.lit(1.0), _sum([F.lit(0.0), *letters]))

    def believed(name: str) -> Column:
        if not 0 < trust < 1 or len(table) == 1:
            return F.lit(0.0)
        return F.when(F.col("label").isNull(), 0.0).when(F.col("label") == name, math.log(trust)).otherwise(math.log((1 - trust) / (len(table) - 1)))

    text = lambda weights: F.lit(SHARPNESS) / total * _sum([F.lit(0.0), *[c * F.lit(w) for c, w in zip(letters, weights, strict=True)]])
    scores = [F.lit(prior) + text(weights) + believed(name) for name, (prior, weights) in table.items()]
    held = counted.select("k1", "k2", "n", *[s.alias(f"s{d}") for d, s in enumerate(scores)])
    top = F.greatest(*[F.col(f"s{d}") for d in domains]) if len(table) > 1 else F.col("s0")
    held = held.select("*", top.alias("top")).select("k1", "k2", "n", *[F.exp(F.col(f"s{d}") - F.col("top")).alias(f"e{d}") for d in domains])
    held = held.select("*", _sum([F.col(f"e{d}") for d in domains]).alias("norm"))
    return held.select("k1", "k2", "n", *[(F.col(f"e{d}") / F.col("norm")).alias(f"p{d}") for d in domains])


def default_targets(totals: np.ndarray, alpha: float, most: float | None) -> np.ndarray:
    """Tempered shares of the expected totals; their sum is the whole input's, or what rates up to ``most`` can reach."""
    shares = np.maximum(totals, 0) / max(totals.sum(), 1e-9)
    wanted = np.where(shares > 0, shares, 0) ** alpha * (shares > 0)
    wanted = wanted / max(wanted.sum(), 1e-9)
    if most is None:
        return wanted * totals.sum()
    reach = [most * t / w for t, w in zip(totals, wanted, strict=True) if w > 0]
    return wanted * min([totals.sum() * most, *reach])


def fitted(members: DataFrame, domains: int, targets: np.ndarray | None, alpha: float, most: float | None, tables: Written | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``members`` (n, p0, p1, ...) with ``rate``; the targets; and the totals that the rates reach.

    The gradient of a domain is divided by the tokens of it whose rates can move. As posteriors sum to 1, these are the row sums
    of the Gram matrix, which therefore never exceeds them: a whole step does not overshoot, whatever the posteriors.
    """
    p = [F.col(f"p{d}") for d in range(domains)]
    tables = tables or Written(members.sparkSession, "fit")

    def clipped(column: Column) -> Column:
        column = F.greatest(F.lit(0.0), column)
        return column if most is None else F.least(F.lit(float(most)), column)

    def sums(at: Column) -> tuple[np.ndarray, np.ndarray]:
        free = F.when(F.col("now") > 0, F.col("n")).otherwise(0.0)
        held = members.select("*", at.alias("now")).select("*", free.alias("free"), (F.col("now") * F.col("n")).alias("taken"))
        row = held.agg(*[F.sum(F.col("taken") * p[d]).alias(f"t{d}") for d in range(domains)], *[F.sum(F.col("free") * p[d]).alias(f"f{d}") for d in range(domains)]).first()
        return np.array([row[f"t{d}"] or 0.0 for d in range(domains)]), np.array([row[f"f{d}"] or 0.0 for d in range(domains)])

    rate = clipped(F.lit(1.0))
    reached, free = sums(rate)
    whole = max(reached.sum(), 1e-9)
    weight = 1 / np.maximum(reached, 1e-9 * whole)
    targets = default_targets(reached, alpha, most) if targets is None else targets
    size, best, steps, written = 1.0, None, 0, []
    for passed in range(PASSES):
        loss = float((weight * (reached - targets) ** 2).sum())
        if best is None or loss < best[0]:
            steps += 1
            if steps > STEPS:
                members, steps = tables.keep(members.withColumn("rate", rate), f"rates{passed}"), 0
                rate = F.col("rate")
                tables.drop(*written)
                written = [f"rates{passed}"]
            best = (loss, rate, reached, (reached - targets) / np.maximum(free, 1e-9 * whole))
        else:
            size /= 2
        if np.abs(best[2] - targets).max() <= CLOSE * whole or size < 0.01:
            break
        rate = clipped(best[1] - _sum(p[d] * F.lit(float(size * best[3][d])) for d in range(domains)))
        reached, free = sums(rate)
    return members.withColumn("rate", best[1]), targets, best[2]


def rated(
    docs: DataFrame, label: str = "source", targets: dict[str, float] | None = None, alpha: float = ALPHA, most: float | None = None,
    trust: float = TRUST, most_domains: int = MOST_DOMAINS,
) -> DataFrame:
    """``docs`` as a struct ``row``, with ``domain``, ``confidence``, ``n_tokens``, ``rate``, ``copies``, ``target`` and ``reached``.

    ``targets`` maps labels to expected tokens. ``copies`` is the rate rounded up or down by a hash of the row, so that
    its mean is the rate. ``target`` and ``reached`` are the expected tokens of the row's domain that were asked for and that the rates give:
    where they differ, no rates give the targets, or the passes did not suffice.
    """
    tables = Written(docs.sparkSession, "mixing")
    own = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")
    key = [F.xxhash64("row.doc_id", "text", "label").alias("k1"), F.hash("text", "label", "row.doc_id").alias("k2")]
    held = docs.select(row, F.col(f"`{label}`").cast("string").alias("label"), text_of(F.col("`text`")).alias("text"))
    docs_of = labels_of(held, most_domains)
    if not docs_of:
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (("domain", "string"), ("confidence", "double"))]
        made = [F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"), *[F.lit(None).cast("double").alias(name) for name in ("target", "reached")]]
        return held.select("row", *none, F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"), *made)
    keyed = held.select(*key, "label", "text")
    letters = telling(keyed, docs_of, tables)
    counts = [c.alias(f"c{k}") for k, c in enumerate(letter_counts(F.lower("text"), letters))]
    counted = tables.keep(keyed.select("k1", "k2", "label", F.size(words_of(F.col("text"))).cast("double").alias("n"), *counts), "counted")
    names = list(docs_of)
    members = tables.keep(posteriors(counted, learned(counted, docs_of, len(letters)), trust), "members")
    aims = None if targets is None else np.array([float(targets.get(x, 0.0)) for x in names])
    rates, aims, reached = fitted(members, len(names), aims, alpha, most, tables)
    top = F.greatest(*[F.col(f"p{d}") for d in range(len(names))]) if len(names) > 1 else F.col("p0")
    of_domain = lambda values: F.coalesce(*[F.when(F.col(f"p{d}") == F.col("confidence"), F.lit(x)) for d, x in enumerate(values)])
    draw = F.pmod(F.xxhash64(F.col("k2"), F.col("k1")), F.lit(1_000_000)) / 1_000_000
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    rates = rates.withColumn("confidence", top).select(
        "k1", "k2", of_domain(names).alias("domain"), "confidence", F.col("n").cast("long").alias("n_tokens"), "rate", copies.cast("long").alias("copies"),
        of_domain([float(x) for x in aims]).alias("target"), of_domain([float(x) for x in reached]).alias("reached"),
    )
    rates = tables.keep(rates.dropDuplicates(["k1", "k2"]), "rates")
    tables.drop("counted", "members", "cells")
    return held.select("row", *key).join(rates, ["k1", "k2"], "left").drop("k1", "k2")


def mixed(docs: DataFrame, label: str = "source", targets: dict[str, float] | None = None, alpha: float = ALPHA, most: float | None = None) -> DataFrame:
    """The documents, each as often as its copies say, with the columns they came with."""
    rows = rated(docs, label, targets, alpha, most).filter("copies > 0")
    rows = rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")) if most is None or most > 1 else rows
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
