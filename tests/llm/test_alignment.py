"""The alignment operator against a plain version, and its fragments against whole documents."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from assayflow.llm import alignment
from assayflow.llm.alignment import Fragment, Run


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Aligner(*alignment.default_tokenizers())


def plainly(texts, aligner):
    """Rows by whole-text encoding and plain loops over bytes."""
    docs = []
    tokenizer = Tokenizer.from_file(alignment.default_tokenizers()[0])
    tokenizer.encode_special_tokens = True
    for text in texts:
        tokens = None
        if text:
            a = tokenizer.encode(" " + text, add_special_tokens=False).ids
            b = aligner.b.encode(text)
            a = [(x, aligner.a_bytes[x]) for x in a]
            b = [(x, aligner.b_bytes[x]) for x in b]
            whole = (" " + text).encode()
            if b"".join(x[1] for x in a) == whole == b"".join(x[1] for x in b):
                tokens = a, b
        if not tokens:
            docs.append(None)
            continue
        spans = []
        for side in tokens:
            at, own = 0, []
            for number, raw in side:
                own.append((at, at + len(raw), number))
                at += len(raw)
            spans.append(own)
        links, j = [], 0
        for begin, end, number in spans[0]:
            while spans[1][j][1] <= begin:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < end:
                links.append((number, spans[1][k][2]))
                k += 1
        both = {x[1] for x in spans[0]} & {x[1] for x in spans[1]}
        groups, open_a, j = [], [], 0
        for _, end, number in spans[0]:
            open_a.append(number)
            if end in both:
                open_b = []
                while j < len(spans[1]) and spans[1][j][1] <= end:
                    open_b.append(spans[1][j][2])
                    j += 1
                groups.append(",".join(map(str, open_a)) + "|" + ",".join(map(str, open_b)))
                open_a = []
        docs.append((len(spans[0]), len(spans[1]), groups, links))
    counts = Counter(x for d in docs if d for x in d[3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for d in docs:
        if not d:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_best = sum(counts[x] == best[x[1]] for x in d[3])
        out.append((d[0], d[1], len(d[2]), len(d[3]), n_best, sum(counts[x] for x in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()))
    return out


ODD = [
    "plain words, twice: plain words", "a  b   c\n\n d \t e", " leading", "trailing ", "   ", "\n", "naïve café ① ﬁ 漢字仮名 кириллица", "a▁b", "x\0y z",
    "<|endoftext|> and <s> </s> <0x41>", "no break     spaces", "don't can't we'll 's", "1234567 12.5% $3,000", "\U0001f600 \U0001f469‍\U0001f4bb end",
    "word" * 400, "漢字" * 300, "é" * 50 + " " + "ñ" * 51, None, "", "plain words, twice: plain words", "é ́x ́", "\x1c \x1d a", "tail\r\n", "▁",
]


@pytest.mark.parametrize("size,fan", [(1 << 18, 16), (40, 2), (7, 3), (1, 2)])
def test_equals_plain_alignment(docs_of, corpus, tokenizers, size, fan):
    texts = ODD + [text for _, text in corpus if text is None or len(text) < 2000]
    rows = docs_of([(n, text) for n, text in enumerate(texts)])
    found = {r[0]: tuple(r)[1:] for r in alignment.aligned(rows, size=size, fan=fan, chunk_links=500).collect()}
    assert found == dict(enumerate(plainly(texts, tokenizers)))


def test_very_long_text_and_odd_rows(spark, docs_of, tokenizers):
    draw = random.Random(2)
    long = " ".join("".join(draw.choice("abcdeé漢") for _ in range(draw.randint(1, 9))) for _ in range(60_000))
    rows = [(1, long), (1, long), (None, "null id"), (3, long + " a▁b")]
    found = sorted((r[0] or 0, *tuple(r)[1:]) for r in alignment.aligned(docs_of(rows), size=20_000, fan=3).collect())
    wanted = sorted((n or 0, *x) for n, x in zip((1, 1, None, 3), plainly([t for _, t in rows], tokenizers), strict=True))
    assert found == wanted
    assert alignment.aligned(docs_of([])).collect() == []


def fragment_of_range(run, begin, end):
    """The fragment of the tokens that end after ``begin`` and up to ``end``."""
    ends_a, ends_b = np.cumsum(run.a_size), np.cumsum(run.b_size)
    a, b = (slice(*np.searchsorted(e, [begin, end], side="right")) for e in (ends_a, ends_b))
    start = lambda e, s: int(e[s.start - 1]) if s.start else 0
    return Fragment.of(run.part(a, b), start(ends_a, a), start(ends_b, b))


def shown(fragment):
    return (fragment.ends, fragment.prefix.packed(), [g.packed() for g in fragment.closed], fragment.suffix.packed())


def test_fragments_are_a_monoid(tokenizers):
    """Ranges may end anywhere, inside tokens too: composed in any order they give the whole."""
    draw = random.Random(5)
    for text in ["some words, naïve café ① 漢字仮名 and more tokens 12345", "漢字①é" * 30, "ab" * 60]:
        run = tokenizers.run(text)
        whole, size = Fragment.of(run), int(run.a_size.sum())
        for _ in range(30):
            cuts = [0, *sorted(draw.sample(range(1, size), 5)), size]
            parts = [fragment_of_range(run, *cuts[k : k + 2]) for k in range(6)]
            left = parts[0]
            for p in parts[1:]:
                left = left + p
            right = parts[-1]
            for p in reversed(parts[:-1]):
                right = p + right
            assert shown(left) == shown(right) == shown((parts[0] + parts[1]) + (parts[2] + parts[3]) + (parts[4] + parts[5])) == shown(whole)
            assert shown(Fragment() + left) == shown(left + Fragment()) == shown(left)


def test_links_are_the_overlaps():
    run = Run(np.array([1, 2, 3]), np.array([2, 3, 1]), np.array([7, 8]), np.array([3, 3]))
    assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in run.links()] == [(1, 7), (2, 7), (2, 8), (3, 8)]


def test_links_are_counted_as_they_come_and_not_held():
    """What a chunk holds is its different pairs, not all links that it has seen."""
    rng, tally, seen, most = np.random.default_rng(3), alignment.Tally(), [], 0
    for _ in range(50):
        own = rng.integers(0, 500, 100_000)
        tally.add([own])
        seen.append(own)
        most = max(most, tally.waiting)
    tally.fold()
    pairs, counts = np.unique(np.concatenate(seen), return_counts=True)
    assert tally.pairs.tolist() == pairs.tolist() and tally.counts.tolist() == counts.tolist()
    assert tally.added == 5_000_000 and most < 2 * alignment.FOLDED
