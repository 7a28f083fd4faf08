"""The operators on texts against plain Python on a small corpus with the odd cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
import textwrap
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayflow.llm import licenses, lines, minhash, rules, substrings
from assayflow.llm.common import TIDY

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sorted_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_near_copies_equal_brute_force(docs_of, corpus):
    got = sorted_rows(minhash.classes(docs_of(corpus)).select("doc_id", "n_shingles", "component_id", "kept"))
    sets = {}
    for doc_id, text in corpus:
        w = words(lowered(text))
        sets[doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets if d is not None}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in root:
        for b in root:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = [(d, len(sets[d]) if d is not None else len(set(_grams(t))), None if d is None else find(d), d is None or find(d) == d) for d, t in corpus]
    assert got == sorted(want, key=repr)
    assert sum(not r[3] for r in got) >= 5


def _grams(text):
    w = words(lowered(text))
    return [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []


def test_many_near_copies_link_through_blocks(spark, docs_of, monkeypatch):
    """Copies that all differ, with blocks far smaller than their group: one component, found by comparing cells."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[:k] + ["other"] + base[k + 1 :])) for k in range(60)] + [(100 + k, f"own text {k} of its own kind") for k in range(9)]
    got = {r.doc_id: r.component_id for r in minhash.classes(docs_of(rows)).collect()}
    assert {got[k] for k in range(60)} == {0}
    assert all(got[100 + k] == 100 + k for k in range(9))


def test_without_near_copies_keeps_columns(docs_of, corpus):
    docs = docs_of(corpus)
    kept = minhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids[1] == 1 and not ids[2] and not ids[50] and ids[None] == 2 and ids[5] == ids[6] == 1


def measured(text):
    w, t = words(text), text or ""
    grams = defaultdict(list)
    for k in range(len(w) - 4):
        grams[tuple(w[k : k + 5])].append(k)
    covered = {k + j for places in grams.values() if len(places) > 1 for k in places for j in range(5)}
    own = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), len(covered)


def test_ledger_equals_plain_python(docs_of, corpus):
    got = sorted_rows(rules.judged(rules.ledger(docs_of(corpus))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = []
    for doc_id, text in corpus:
        m = measured(text)
        want.append((doc_id, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert got == sorted(want, key=repr)


def test_policies_and_ablations(docs_of, corpus):
    ledger = rules.ledger(docs_of(corpus)).cache()
    kept = rules.judged(ledger, rules.FULL).filter("kept").count()
    rows = {(r.policy, r.rule): r for r in rules.ablations(ledger, [rules.BASE, rules.FULL]).collect()}
    failed = [r.failed for r in ledger.collect()]
    for policy in (rules.BASE, rules.FULL):
        for rule in policy.rules:
            bit, r = rules.BIT[rule], rows[policy.name, rule]
            hit = [f & policy.mask for f in failed]
            assert (r.fail, r.fail_alone, r.kept_without) == (sum(h & bit > 0 for h in hit), sum(h == bit for h in hit), sum(h & ~bit == 0 for h in hit))
    good = rules.keep_good(docs_of(corpus))
    assert good.columns == docs_of(corpus).columns and good.count() == kept


def test_common_lines_equal_plain_python(docs_of, corpus):
    key = lambda line: lowered(line).strip(" \t\n\x0b\x0c\r")
    of_document = [(place if doc_id is None else f"id {doc_id}", key(x)) for place, (doc_id, text) in enumerate(corpus) for x in (text or "").split("\n")]
    held = Counter(k for _, k in set(of_document) if k)
    want = []
    for doc_id, text in corpus:
        own = (text or "").split("\n")
        stay = [x for x in own if held[key(x)] < 10]
        want.append((doc_id, len(own), len(own) - len(stay), sha("\n".join(stay))))
    rows = lines.drop_common_lines(docs_of(corpus), batches=4)
    assert sorted_rows(rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))) == sorted(want, key=repr)
    assert sum(r[2] for r in want) >= 24


def test_lines_are_counted_by_document_and_not_by_row(docs_of):
    rows = [(1, "here alone\nin two")] * 10 + [(2, "in two\nin ten")] + [(k, f"own {k}\nIn Ten ") for k in range(3, 12)] + [(3, "another text of 3\nin ten")] * 12
    rows += [(None, "no id")] * 9 + [(None, "no id\nmore"), (12, "")]
    got = {}
    for r in lines.drop_common_lines(docs_of(rows)).collect():
        got.setdefault(r.doc_id, set()).add((r.n_lines, r.n_dropped, r.kept_text))
    assert got[1] == {(2, 0, "here alone\nin two")} and got[2] == {(2, 1, "in two")}
    assert got[3] == {(2, 1, "own 3"), (2, 1, "another text of 3")} and got[11] == {(2, 1, "own 11")}
    assert got[None] == {(1, 1, ""), (2, 1, "more")} and got[12] == {(1, 0, "")}


def test_runs_settle_and_compact(spark):
    runs = lines.Runs(spark, min_docs=3, fan=2)
    batch = lambda *keys: spark.createDataFrame([(bytes([k]) * 16,) for k in keys], "digest binary")
    for keys in ((1, 1, 2), (1, 2, 3), (1, 2, 4), (3, 4), (3, 5)):
        runs.add(batch(*keys))
    assert sorted(r.digest[0] for r in runs.common().collect()) == [1, 2, 3]


def test_stage_of_line_dedup_keeps_columns_and_nulls(docs_of, corpus):
    docs = docs_of(corpus)
    rows = lines.without_common_lines(docs)
    assert rows.schema.names == docs.schema.names
    got = {r.doc_id: r for r in rows.collect() if r.doc_id is not None}
    assert got[5].text is None and got[6].text == "" and "hared" not in got[20].text and got[20].n_chars == len(got[20].text)


@pytest.mark.parametrize("narrow", [0, 16])
def test_links_between_components_of_a_bucket(docs_of, monkeypatch, narrow):
    """A chain in which only neighbours are similar, with groups of copies: whichever way the rest of a bucket is compared."""
    monkeypatch.setattr(minhash, "NARROW", narrow)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    order = [7, 3, 11, 0, 9, 5, 1, 10, 4, 8, 2, 6]
    rows = [(doc_id, " ".join(f"w{k}" for k in range(6 * at, 6 * at + 64))) for at, doc_id in enumerate(order)] + [(50, "nothing like the others at all")]
    got = {r.doc_id: r.component_id for r in minhash.classes(docs_of(rows)).collect()}
    assert {got[k] for k in range(12)} == {0} and got[50] == 50


def test_joining_stops_at_joined_roots():
    import numpy as np

    sets = [np.arange(a, a + 40, dtype=np.uint64) for a in (0, 2, 4, 100, 101)] + [np.arange(500, 510, dtype=np.uint64)]
    pairs = minhash.joining([1, 2, 3, 4, 4, 9], sets)
    assert sorted(tuple(sorted(p)) for p in pairs) == [(0, 1), (0, 2)]


@pytest.mark.parametrize("hot", [256, 2])
def test_substrings_equal_brute_force(docs_of, corpus, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 500)
    low = {}
    for doc_id, text in corpus:
        w = words(text)
        for k in range(len(w) - 49) if doc_id is not None else ():
            g = tuple(w[k : k + 50])
            low[g] = min(low.get(g, doc_id), doc_id)
    want = []
    for doc_id, text in corpus:
        w = words(text)
        gone = {k + j for k in range(len(w) - 49) if doc_id is not None and low[tuple(w[k : k + 50])] < doc_id for j in range(50)}
        want.append((doc_id, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    rows = substrings.without_repeats(docs_of(corpus))
    assert sorted_rows(rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))) == sorted(want, key=repr)
    assert sum(r[2] for r in want) > 600


def test_edge_windows_alone_in_their_piece(docs_of):
    """Pairs that share exactly one or 21 windows, whose edge windows may be a piece of their own in one of the two only."""
    draw = random.Random(11)
    text = lambda n: [f"{draw.getrandbits(40):x}" for _ in range(n)]
    rows, want = [], []
    for pair in range(3000):
        size = (50, 70)[pair % 2]
        shared = text(size)
        for k in range(2):
            before, after = text(draw.randint(1, 40)), text(draw.randint(1, 40))
            rows.append((2 * pair + k, " ".join(before + shared + after)))
            want.append((2 * pair + k, size * k, " ".join(before + after if k else before + shared + after)))
    got = substrings.without_repeats(docs_of(rows)).select("doc_id", "n_removed", "kept_text").collect()
    wrong = [g[0] for g, w in zip(sorted(map(tuple, got)), want, strict=True) if g != w]
    assert not wrong, f"{len(wrong)} documents: {wrong[:10]}"


def _shuffles_on_disk(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name.split("_")[1] for d in folders for f in Path(d.getPath()).glob("*/shuffle_*.data")}


def test_substrings_keep_no_shuffle_files_of_written_steps(spark, docs_of, corpus):
    """Only the count of words, a row a task, may stay: disk must not wait for the driver to collect its garbage."""
    before, setting = _shuffles_on_disk(spark), spark.conf.get(TIDY)
    rows = substrings.without_repeats(docs_of(corpus))
    for _ in range(50):
        if len(left := _shuffles_on_disk(spark) - before) <= 1:
            break
        time.sleep(0.1)
    assert len(left) <= 1, f"{len(left)} shuffles stay"
    assert spark.conf.get(TIDY) == setting
    assert rows.count() == len(corpus)


def test_pieces_carry_their_words_as_text():
    """Text is compressed where it is shuffled and written; 64-bit hashes of words are not, and need eight bytes a word."""
    draw = random.Random(5)
    own = [f"w{draw.randint(0, 999)}" for _ in range(300)]
    _, runs = substrings.anchors(substrings.WordHashes().of([w.encode() for w in own]))
    every = runs.view("int64").tolist()
    for hot in ([], every):
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "k1": [1], "k2": pa.array([1], pa.int32()), "text": ["\n ".join(own)], "shared": [every], "hot": pa.array([hot], pa.list_(pa.int64()))})
        pieces = [r for b in substrings._cut(iter([batch])) for r in b.to_pylist()]
        assert sorted(r["start"] + k for r in pieces for k in range(r["windows"])) == list(range(251))
        assert all(r["words"].decode() == " ".join(own[r["start"] : r["start"] + r["windows"] + 49]) for r in pieces)


def test_licence_texts_match_in_any_spelling(docs_of):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and "hereby" in t)
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (2, mit.replace("sublicense", "sub" + "licence").replace(", ", " -- ")), (3, "Some text.\nReleased under the M.I.T. Licence"), (4, "Some text.\n  ** Released under the MIT Licence!!\nMore."), (5, None), (6, ""), (7, "(c) All"), (None, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in licenses.scanned(docs_of(rows)).collect()}
    assert got[1].license_id == "MIT" and got[2].license_id == "MIT"
    assert got[3].licenses is None and got[4].licenses == "MIT" and got[4].n_notices == 1 and got[4].license_id is None
    assert got[5].digest is None and got[6].digest is None and got[7].digest is None
    assert got[None].license_id == "CC-BY-NC-4.0"


def test_full_licence_texts_whole_and_inside(docs_of):
    texts = {n: (Path(licenses.__file__).parent / "license_texts" / f"{n}.txt").read_text() for n in licenses.FILES}
    rows = [(k, "Copyright (c) 1999 Me\n\n" + texts[n]) for k, n in enumerate(licenses.FILES)]
    rows += [(100 + k, "Own words before.\n\n" + texts[n] + "\n\nOwn words\nafter.") for k, n in enumerate(licenses.FILES)]
    rows += [(200, texts["Zlib"].rsplit("\n\n", 1)[0] + "\n\nanother end")]
    got = {r.doc_id: r for r in licenses.scanned(docs_of(rows)).collect()}
    for k, name in enumerate(licenses.FILES):
        own = name.split("+")[0]
        assert got[k].license_id == own and got[100 + k].license_id is None, name
        assert own in (got[100 + k].licenses or "").split(","), name
    assert got[200].license_id is None and got[200].licenses is None and got[200].n_notices == 0


@pytest.mark.parametrize("width", [50, 60, 72, 100, 10_000])
def test_licence_texts_wrapped_anew(docs_of, width):
    """Every known text at any width, with Windows line ends or not, whole and inside other text."""
    def wrapped(text):
        blocks = re.split(r"\n\s*\n", text)
        return "\n\n".join(textwrap.fill(" ".join(block.split()), width, break_long_words=False, break_on_hyphens=False) for block in blocks)

    texts = dict(zip(licenses.FILES, [text for _, text in licenses.file_texts()], strict=True))
    rows = [(k, wrapped("Copyright 2001-2019 Some One and others <a@b.c>\nAll rights reserved.\n\n" + t).replace("\n", "\r\n" if k % 2 else "\n")) for k, t in enumerate(texts.values())]
    rows += [(100 + k, "Own words before.\n\n" + wrapped(t) + "\n\nOwn words\nafter.") for k, t in enumerate(texts.values())]
    got = {r.doc_id: r for r in licenses.scanned(docs_of(rows)).collect()}
    for k, name in enumerate(texts):
        own = name.split("+")[0]
        assert got[k].license_id == own and got[100 + k].license_id is None, name
        assert own in (got[100 + k].licenses or "").split(","), name


@pytest.mark.parametrize("call", [minhash.classes, rules.ledger, lines.drop_common_lines, substrings.without_repeats, licenses.scanned, minhash.without_near_copies, rules.keep_good, lines.without_common_lines])
def test_empty_table(docs_of, call):
    assert call(docs_of([])).count() == 0
