import random

import pytest
from pyspark.sql import types as T

COLUMNS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that the operators use inside
    + [T.StructField(c, T.StringType()) for c in ("row", "ledger", "words", "lines", "gone", "stay", "id", "class", "key", "k1", "rate", "kept", "component_id", "failed", "copies")]
)


def made(rows):
    """Rows (doc_id, text[, lang]) with the other columns filled in."""
    out = []
    for doc_id, text, *lang in rows:
        out.append((doc_id, text, lang[0] if lang else "en", "src0", None if text is None else len(text)) + ("x",) * (len(COLUMNS) - 5))
    return out


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows: spark.createDataFrame(made(rows), COLUMNS)


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared lines and passages, nulls, blanks, a very long one, ties and repeated rows."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdeéñü") for _ in range(draw.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(120), text(70)
    near = base.split(" ")
    near[60] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, base.upper().replace("É", "é").replace("Ñ", "ñ").replace("Ü", "ü")), (5, None), (6, ""), (7, " \t\n\x0b "), (8, "three short words"), (9, "three  short\nwords")]
    rows += [(10 + k, text(30) + " " + passage + " " + text(25)) for k in range(6)]
    rows += [(20 + k, text(20) + "\nShared Line \n" + text(5) + "\n\n  shared line") for k in range(12)]
    rows += [(40, text(15_000)), (41, ("again and again " * 400).strip()), (42, "one\ntwo\ntwo\n\n \ntwo"), (43, "a " * 49 + "b"), (44, "x| y# *$ %&<> " * 5)]
    rows += [(50, base), (50, base), (None, base), (None, "no id here")]
    return rows
