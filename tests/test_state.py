"""Streaming state: documents that come in parts, sources that fall silent, and queries that end inside a batch."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayflow.operators import texts
from assayflow.streaming import jobs as K
from assayflow.streaming import state as S

BLOCKS = "document_id long, page int, position long, text string, is_table boolean, blocks long, seen_at timestamp"
VECTORS = "chunk_id string, content string, embedding array<float>"


def block(document, position, blocks, hour=0, text=None):
    return document, position // 4 + 1, position, text or f"text {position} of {document} " + "word " * 150, False, blocks, datetime(2024, 1, 1) + timedelta(hours=hour)


class Folder:
    """A folder of files that arrive one delivery after the other."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema

    def deliver(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def stream(self, files=None):
        reader = self.spark.readStream.schema(T._parse_datatype_string(self.schema))
        return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{self.path}/in")


@pytest.fixture
def blocks(spark, tmp_path):
    return Folder(spark, tmp_path, BLOCKS)


def test_a_document_in_parts_keeps_all_chunks(spark, blocks):
    none = spark.createDataFrame([], VECTORS)

    def run():
        K.run_available(*K.chunk_job(S.whole_documents(blocks.stream()), none, f"{blocks.path}/store"), f"{blocks.path}/checkpoint")
        return sorted(tuple(r)[:6] for r in K.current_chunks(spark, f"{blocks.path}/store").collect())

    first, second = [block(1, n, 12) for n in range(12)], [block(2, n, 5 if n == 4 else None) for n in range(5)]
    blocks.deliver(first[7:] + second[:2])
    assert run() == []
    blocks.deliver(first[:7][::-1] + [first[9]])
    done = run()
    assert {r[0] for r in done} == {1}
    blocks.deliver(second[2:])
    whole = spark.createDataFrame(first + second, BLOCKS)
    wanted = sorted(tuple(r) for r in texts.chunk_blocks(whole).collect())
    assert run() == wanted and len(wanted) > 4
    assert run() == wanted
    # a document that is parsed anew replaces its chunks
    again = [block(2, n, 2, text=f"new {n}") for n in range(2)]
    blocks.deliver(again[:1])
    assert run() == wanted
    blocks.deliver(again[1:])
    fresh = sorted(tuple(r) for r in texts.chunk_blocks(spark.createDataFrame(first + again, BLOCKS)).collect())
    assert run() == fresh


def test_an_incomplete_document_leaves_when_its_wait_is_over(spark, blocks):
    def run():
        stream = S.whole_documents(blocks.stream(), delay="1 hour", wait=timedelta(hours=5))
        K.run_available(stream, K.update_job(f"{blocks.path}/store"), f"{blocks.path}/checkpoint")
        rows = K.read_batches(spark, f"{blocks.path}/store", S.BLOCK).collect()
        return sorted((r.document_id, r.position, r.complete) for r in rows)

    blocks.deliver([block(1, 0, 3), block(1, 1, 3)])
    blocks.deliver([block(9, 0, 1, hour=4)])
    assert run() == [(9, 0, True)]
    blocks.deliver([block(10, 0, 1, hour=9)])
    left = run()
    assert left == [(1, 0, False), (1, 1, False), (9, 0, True), (10, 0, True)]
    # what comes after it makes it whole
    blocks.deliver([block(1, 2, 3, hour=9)])
    assert run() == sorted(left + [(1, n, True) for n in range(3)])


def test_a_batch_costs_state_by_shelves_and_not_by_blocks(spark, blocks):
    """A call to the state costs more than the block it moves: 9,000 blocks of 3,000 open documents are no 9,000 calls."""
    blocks.deliver([block(d, n, 4, text="short") for d in range(3000) for n in range(3)])
    query = K.run_available(S.whole_documents(blocks.stream()), K.update_job(f"{blocks.path}/store"), f"{blocks.path}/checkpoint")
    updated = sum(p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.stateOperators)
    assert 0 < updated <= 4 * 1024
    blocks.deliver([block(d, 3, 4, text="short") for d in range(3000)])
    K.run_available(S.whole_documents(blocks.stream()), K.update_job(f"{blocks.path}/store"), f"{blocks.path}/checkpoint")
    rows = K.read_batches(spark, f"{blocks.path}/store", S.BLOCK)
    assert rows.count() == rows.select("document_id", "position").distinct().count() == 12000


class Held:
    """State of one key in memory, with the timers that are set."""

    def __init__(self):
        self.values, self.timers, self.states = {}, set(), {}

    def getMapState(self, name, *_):
        own = self.states.setdefault(name, {})
        return SimpleNamespace(getValue=own.get, updateValue=own.__setitem__, removeKey=own.__delitem__)

    def getValueState(self, name, *_):
        own = self.states.setdefault(name, {})
        return SimpleNamespace(get=lambda: own.get(0), update=lambda v: own.__setitem__(0, v), clear=own.clear)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


@pytest.mark.parametrize("seed", range(8))
def test_documents_of_a_shelf_leave_as_each_alone_would(monkeypatch, seed):
    """Random deliveries with repeats, unknown lengths and waits that end, against plain dictionaries."""
    for name, value in (("PART", 300), ("HELD", (900, 5000)[seed % 2]), ("LEAST", 3), ("SENT", 4)):
        monkeypatch.setattr(S, name, value)
    draw, wait = random.Random(seed), 50
    held = Held()
    open_documents = S.OpenDocuments(timedelta(milliseconds=wait))
    open_documents.init(held)
    plain: dict[int, dict] = {}
    sizes = {d: draw.choice([0, 1, 2, 5, 30]) for d in range(12)}
    moment = watermark = left = 0
    for step in range(120):
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)  # noqa: B023
        rows = []
        for _ in range(draw.randrange(25)):
            document = draw.randrange(12)
            rows.append((document, draw.randrange(1, 3), draw.randrange(max(1, sizes[document] // 2)), draw.choice([None, f"{step} " + "x" * draw.randrange(90)]), False, draw.choice([None, sizes[document]]), moment + draw.randrange(9)))
        wanted = []
        for document, page, position, text, is_table, blocks, at in rows:
            own = plain.setdefault(document, {"blocks": {}, "wanted": -1})
            own["blocks"][page, position] = (text, is_table)
            own["wanted"] = own["wanted"] if blocks is None else blocks
            own["newest"] = max(own["newest"] if own.get("step") == step else watermark, at)
            own.update(step=step, due=own["newest"] + wait, left=False)
        for document, own in list(plain.items()):
            if own["step"] == step and 0 <= own["wanted"] <= len(own["blocks"]):
                wanted += [(document, *place, *b, True) for place, b in own["blocks"].items()]
                del plain[document]
        names = ["document_id", "page", "position", "text", "is_table", "blocks", "moment"]
        parts = [pd.DataFrame(rows[n : n + 7], columns=names) for n in range(0, len(rows), 7)]
        got = [tuple(r) for f in (open_documents.handleInputRows((0,), iter(parts), clock) if rows else []) for r in f.astype(object).where(f.notna(), None).itertuples(index=False)]
        assert sorted(got, key=repr) == sorted(wanted, key=repr)
        left += len(got)
        moment += draw.choice([0, 3, 30])
        watermark = max(watermark, moment - 10)
        wanted = []
        for document, own in list(plain.items()):
            if own["due"] <= watermark and own["left"]:
                del plain[document]
            elif own["due"] <= watermark:
                wanted += [(document, *place, *b, False) for place, b in own["blocks"].items()]
                own.update(left=True, due=own["due"] + wait)
        got = []
        for timer in [t for t in held.timers if t <= watermark]:
            held.timers.remove(timer)
            for f in open_documents.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), SimpleNamespace(getExpiryTimeInMs=lambda: timer)):  # noqa: B023
                got += [tuple(r) for r in f.astype(object).where(f.notna(), None).itertuples(index=False)]
        assert sorted(got, key=repr) == sorted(wanted, key=repr)
        assert len(held.timers) == bool(plain) and (not plain or min(held.timers) <= min(own["due"] for own in plain.values()))
    assert left > 100
    # when all have left, nothing is held
    for _ in range(3):
        watermark += 10 * wait
        for timer in list(held.timers):
            held.timers.remove(timer)
            for _f in open_documents.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), SimpleNamespace(getExpiryTimeInMs=lambda: timer)):  # noqa: B023
                pass
    assert not held.timers and not any(held.states.values())


EVENTS = "source string, ts timestamp"


def at(hour, minute=0):
    return datetime(2024, 3, 1) + timedelta(hours=hour, minutes=minute)


def test_silence_of_sources_out_of_order(spark, tmp_path):
    events = Folder(spark, tmp_path, EVENTS)

    def run():
        found = S.silent_sources(events.stream(), "ts", "source", timedelta(hours=24), "1 hour")
        K.run_available(found, K.update_job(f"{events.path}/store"), f"{events.path}/checkpoint")
        return sorted(((r.source, r.silent_from, r.silent_to) for r in K.read_batches(spark, f"{events.path}/store", S.SILENCE).collect()), key=str)

    events.deliver([("a", at(30)), ("a", at(0)), ("b", at(0)), ("a", at(10)), ("b", at(23)), ("a", at(5))])
    assert run() == []
    events.deliver([("b", at(60)), ("b", at(50)), ("a", at(53))])
    # b was silent from 23 to 50, and a, whose last event is at 53, is not yet
    assert run() == [("b", at(23), at(50))]
    events.deliver([("b", at(79))])
    # the watermark is at 78: a has been silent for a day
    assert run() == [("a", at(53), None), ("b", at(23), at(50))]
    events.deliver([("a", at(90)), ("b", at(80))])
    assert ("a", at(53), at(90)) in run()


def test_a_query_that_fails_inside_a_batch_resumes(spark, blocks):
    """The sink fails after it has written its second batch; the next run does that batch again and adds nothing twice."""
    for n in range(6):
        blocks.deliver([block(10 * n + k, p, 4) for k in range(3) for p in range(4) if (p + n) % 2] + [block(10 * (n - 1) + k, p, 4) for k in range(3) for p in range(4) if (p + n) % 2 if n])
    store, checkpoint = f"{blocks.path}/store", f"{blocks.path}/checkpoint"
    job = lambda: K.chunk_job(S.whole_documents(blocks.stream(files=1)), spark.createDataFrame([], VECTORS), store)
    stream, write = job()

    def failing(batch, batch_id):
        write(batch, batch_id)
        if batch_id == 2:
            raise RuntimeError("the sink is gone")

    with pytest.raises(Exception, match="the sink is gone"):
        K.run_available(stream, failing, checkpoint)
    part = K.current_chunks(spark, store).count()
    K.run_available(*job(), checkpoint)
    chunks = K.current_chunks(spark, store)
    assert 0 < part < chunks.count() == chunks.select("chunk_id").distinct().count()
    whole = spark.read.parquet(f"{blocks.path}/in").dropDuplicates(["document_id", "position"])
    whole = whole.join(whole.groupBy("document_id").count().filter("count = 4"), "document_id", "left_semi")
    assert sorted(tuple(r)[:6] for r in chunks.collect()) == sorted(tuple(r) for r in texts.chunk_blocks(whole).collect())
    assert K.read_batches(spark, store, K.STORED_CHUNKS).select(F.max("batch_id")).first()[0] >= 5
