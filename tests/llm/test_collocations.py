"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import pytest

from assayflow.llm import collocations


def plainly(rows, min_count, top):
    """Ranked phrases by counting everything in dictionaries; ``rows`` are (text, lang)."""
    counts, totals = {}, Counter()
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang or "und"] += len(words)
            for size in (1, 2, 3):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, own in counts.items():
        ranked = []
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        for p, a in found.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in found.items()):
                continue
            cuts = [(1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    words = ["of", "the", "New", "york", "é", "Éa", "a-b", "\x00z", "z\x1f", "$5", "red", "blue"]
    rows = []
    for n in range(260):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", " \t ", ", ", "\n", "; ", "\r\n", "!"]) for _ in range(draw.randint(0, 40)))
        rows.append((n, text + draw.choice(["New York City", "new YORK city hall", "", " "]), draw.choice(["en", "en", "en", "fr", None])))
    rows += [(900, None, "en"), (901, "", "de"), (902, "only once here", "it"), (903, "same same same " * 30, "und")]
    return rows + [rows[3]] * 12 + [(None, "New York City", "en")] * 11


@pytest.mark.parametrize("min_count,top,shards,chunk", [(10, 2000, 4, 12_000_000), (10, 5, 3, 300), (2, 40, 4, 60), (3, 2000, 7, 25)])
def test_equals_plain_counting(docs_of, texts, min_count, top, shards, chunk):
    rows = docs_of([(n, text, lang or "??") for n, text, lang in texts]).replace("??", None, ["lang"])
    found = sorted(tuple(r) for r in collocations.collocations(rows, top, min_count, shards, chunk).collect())
    assert found == plainly([(text, lang) for _, text, lang in texts], min_count, top)


def test_one_long_text_and_empty_table(docs_of):
    draw = random.Random(3)
    text = " ".join(draw.choice(["a", "b", "c,", "d\n", "ee"]) for _ in range(30_000))
    found = sorted(tuple(r) for r in collocations.collocations(docs_of([(1, text, "en")]), chunk=1000).collect())
    assert found == plainly([(text, "en")], 10, 2000)
    assert collocations.collocations(docs_of([])).collect() == []


def test_counts_beyond_64_bits(spark):
    """a * a * 1000000 and l * r pass 64 bits; the quotient is exact."""
    big = 3_000_000_019
    counts = [("en", 1, "x", big + 7), ("en", 1, "y", big + 1), ("en", 2, "x y", big)]
    found = collocations.scored(spark.createDataFrame(counts, "lang string, size int, phrase string, f long")).collect()
    assert [r["score"] for r in found] == [1000000 * big * big // ((big + 7) * (big + 1))]


def test_words_that_need_many_numbers(monkeypatch):
    """The way for chunks of very many different words gives what the usual one gives."""
    text = (" ".join(f"w{n % 97} v{n % 13}" for n in range(2000)) + " \n end").encode()
    usual = collocations._Chunk(b"  \n " + text, 1)
    numbers, counts = usual.counted(3)
    wanted = dict(zip(usual.spelled(numbers).to_pylist(), counts.tolist(), strict=True))

    many = collocations._Chunk(b"  \n " + text, 1)
    monkeypatch.setattr(collocations, "MOST_WORDS", 1)
    numbers, counts = many.counted(3)
    assert dict(zip(many.spelled(numbers).to_pylist(), counts.tolist(), strict=True)) == wanted
