"""Keyed state of streaming jobs: documents that are still open, and sources that fall silent.

Both use arbitrary state in the state store (RocksDB), which checkpoints with the query: a query that is ended inside a
batch and started again carries on from the state of the last batch that was done.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import timedelta
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Blocks that leave a task at a time.
SENT = 1000
#: Shelves that documents are dealt to. Once a checkpoint has been written, its number of shelves stays.
SHELVES = 1024
#: Characters of a part, and those a task holds outside the state; a block counts with its text and ``PLACE`` more.
PART, HELD, PLACE = 1 << 16, 1 << 23, 100
#: Blocks that a document of unknown length may hold before repeats are looked for the first time.
LEAST = 256


def use_rocksdb(spark: SparkSession) -> None:
    """State with maps, lists and timers needs the RocksDB store; a running query keeps what it started with."""
    if spark.conf.get(_STORE, "") != _ROCKS:
        spark.conf.set(_STORE, _ROCKS)


def _milliseconds(value: timedelta) -> int:
    return int(value.total_seconds() * 1000)


# --- documents in parts --------------------------------------------------------------------------------

BLOCK = "document_id long, page int, position long, text string, is_table boolean, complete boolean"


def _weight(block: tuple) -> int:
    return PLACE + len(block[2] or "")


@dataclass
class _Open:
    """An open document: blocks announced and held (with repeats), how many to hold before repeats are looked for, when it is
    due, whether it has left incomplete, and the characters of it in each part."""

    wanted: int = -1
    held: int = 0
    room: int = LEAST
    due: int = 0
    left: bool = False
    parts: dict[int, int] = field(default_factory=dict)


class _Shelf:
    """The open documents of a key. Their blocks are in parts, each of many documents, and are only read when one of them leaves.

    A part is written once; it goes with its last document, and is written anew when half of it is of documents that are gone.
    """

    def __init__(self, index: tuple | None, parts):
        self.parts = parts
        self.timer, self.next, packed = index or (None, 0, None)
        rows, self.sizes = pickle.loads(packed) if packed else ({}, {})
        self.open = {document: _Open(*own) for document, own in rows.items()}
        self.thinned: set[int] = set()

    def index(self) -> tuple:
        rows = {document: (o.wanted, o.held, o.room, o.due, o.left, o.parts) for document, o in self.open.items()}
        return self.timer, self.next, pickle.dumps((rows, self.sizes))

    def keep(self, came: dict[int, list[tuple]]) -> None:
        part, size = {}, 0
        for document, blocks in came.items():
            held = self.open[document].parts
            for block in blocks:
                part.setdefault(document, []).append(block)
                weight = _weight(block)
                held[self.next] = held.get(self.next, 0) + weight
                size += weight
                if size >= PART:
                    self._write(part, size)
                    part, size = {}, 0
        if part:
            self._write(part, size)

    def _write(self, part: dict[int, list[tuple]], size: int) -> None:
        self.parts.updateValue((self.next,), (pickle.dumps(part),))
        self.sizes[self.next] = [size, size]
        self.next += 1

    def _part(self, number: int) -> dict[int, list[tuple]]:
        """What a part holds of documents that are still open; one that left and came again has nothing in its old parts."""
        part = pickle.loads(self.parts.getValue((number,))[0])
        return {d: blocks for d, blocks in part.items() if d in self.open and number in self.open[d].parts}

    def read(self, documents: list[int], came: dict[int, list[tuple]]) -> Iterator[tuple[int, list[tuple]]]:
        """Documents with blocks of theirs, part by part, the newest first; of blocks with one place the newest."""
        seen: dict[int, set] = {document: set() for document in documents}
        numbers = sorted({n for document in documents for n in self.open[document].parts}, reverse=True)
        for part in chain([came], map(self._part, numbers)):
            for document in part.keys() & seen.keys():
                newest = {block[:2]: block for block in part[document]}
                yield document, [block for place, block in newest.items() if place not in seen[document]]
                seen[document].update(newest)

    def batches(self, documents: Iterable[int], came: dict[int, list[tuple]]) -> Iterator[tuple[list[int], bool]]:
        """Documents as many at a time as a task may hold, and those alone that are larger, which it may not."""
        some, size = [], 0
        for document in documents:
            weight = sum(self.open[document].parts.values()) + sum(map(_weight, came.get(document, ())))
            if some and size + weight > HELD:
                yield some, size <= HELD
                some, size = [], 0
            some.append(document)
            size += weight
        if some:
            yield some, size <= HELD

    def empty(self, document: int, numbers: list[int]) -> None:
        """These parts hold nothing of the document any longer."""
        for number in numbers:
            self.sizes[number][1] -= self.open[document].parts.pop(number)
            self.thinned.add(number)

    def tidy(self) -> None:
        for number in self.thinned:
            size, live = self.sizes[number]
            if not live:
                self.parts.removeKey((number,))
                del self.sizes[number]
            elif 2 * live <= size:
                self.parts.updateValue((number,), (pickle.dumps(self._part(number)),))
                self.sizes[number] = [live, live]
        self.thinned = set()


class OpenDocuments(StatefulProcessor):
    """Holds documents' blocks until all are there.

    Blocks come in any order and in any batch. Each bears ``blocks``, how many its document has, or null where the sender
    does not know yet. When as many are there, the document leaves whole and its state goes. A document that
    is not complete ``wait`` after the time of its newest block leaves with what it has, marked incomplete; its blocks stay
    another ``wait``, and if more come it leaves again, whole.

    The keys are shelves that documents are dealt to, as each call to the state costs more than the blocks it moves: a batch
    reads and writes a shelf's index once and its blocks in parts, and a shelf has one timer. The index has a short entry for each of the
    shelf's open documents; where very many stay open, more shelves keep it small.
    """

    def __init__(self, wait: timedelta):
        self.wait = _milliseconds(wait)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # blocks by document, pickled: (page, position, text, is_table)
        self.parts = handle.getMapState("parts", "part long", "blocks binary")
        # the timer set, the next part, and the open documents, pickled
        self.index = handle.getValueState("shelf", "timer long, next long, open binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # what is held outside the state are blocks up to HELD, and of each document of the batch its newest moment
        shelf = _Shelf(self.index.get(), self.parts)
        watermark = timerValues.getCurrentWatermarkInMs()
        newest: dict[int, int] = {}
        came: dict[int, list[tuple]] = {}
        size = 0
        for batch in rows:
            columns = (batch[c].tolist() for c in ("document_id", "page", "position", "text", "is_table", "blocks", "moment"))
            for document, page, position, text, is_table, blocks, moment in zip(*columns, strict=True):
                own = shelf.open.setdefault(document, _Open())
                block = int(page), int(position), None if pd.isna(text) else text, bool(is_table)
                came.setdefault(document, []).append(block)
                own.held += 1
                if not pd.isna(blocks):
                    own.wanted = int(blocks)
                newest[document] = max(newest.get(document, watermark), moment)
                size += _weight(block)
                if size >= HELD:
                    shelf.keep(came)
                    came, size = {}, 0
        for document, moment in newest.items():
            shelf.open[document].due, shelf.open[document].left = moment + self.wait, False
        yield from _sent(self._settled(shelf, newest, came))
        self._leave(shelf)

    def _settled(self, shelf: _Shelf, met: Iterable[int], came: dict[int, list[tuple]]) -> Iterator[tuple]:
        """Rows of the documents that are whole; the others are held on."""
        full = [d for d in met if self._may_be_whole(shelf.open[d])]
        for documents, small in list(shelf.batches(full, came)):
            own = {d: came.pop(d) for d in documents if d in came}
            before = {d: list(shelf.open[d].parts) for d in documents}
            found = list(shelf.read(documents, own)) if small else None
            # as blocks may have come twice, these may be fewer than were counted
            there = Counter()
            for document, blocks in found or shelf.read(documents, own):
                there[document] += len(blocks)
            whole = {d for d in documents if 0 <= shelf.open[d].wanted <= there[d]}
            kept: dict[int, list[tuple]] = {}
            size = 0
            for document, blocks in found or shelf.read(documents, own):
                if document in whole:
                    yield from ((document, *block, True) for block in blocks)
                    continue
                kept.setdefault(document, []).extend(blocks)
                size += sum(map(_weight, blocks))
                if size >= HELD:
                    shelf.keep(kept)
                    kept, size = {}, 0
            shelf.keep(kept)
            for document in documents:
                shelf.empty(document, before[document])
                if document in whole:
                    del shelf.open[document]
                else:
                    shelf.open[document].held, shelf.open[document].room = there[document], max(LEAST, 2 * there[document])
        shelf.keep(came)

    def _may_be_whole(self, own: _Open) -> bool:
        return own.wanted <= own.held if own.wanted >= 0 else own.held > own.room

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        shelf = _Shelf(self.index.get(), self.parts)
        shelf.timer = None
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = [document for document, own in shelf.open.items() if own.due <= now]
        for document in over:
            if shelf.open[document].left:
                shelf.empty(document, list(shelf.open[document].parts))
                del shelf.open[document]
        yield from _sent(self._overdue(shelf, [document for document in over if document in shelf.open]))
        self._leave(shelf)

    def _overdue(self, shelf: _Shelf, over: list[int]) -> Iterator[tuple]:
        for documents, _ in shelf.batches(over, {}):
            yield from ((document, *block, False) for document, blocks in shelf.read(documents, {}) for block in blocks)
        for document in over:
            own = shelf.open[document]
            own.due, own.left = own.due + self.wait, True

    def _leave(self, shelf: _Shelf) -> None:
        """The shelf as it is now; its timer is at or before the time at which the first of its documents is due."""
        shelf.tidy()
        due = min((own.due for own in shelf.open.values()), default=None)
        if shelf.timer is not None and (due is None or due < shelf.timer):
            self.handle.deleteTimer(shelf.timer)
            shelf.timer = None
        if due is None:
            self.index.clear()
            return
        if shelf.timer is None:
            self.handle.registerTimer(due)
            shelf.timer = due
        self.index.update(shelf.index())

    def close(self) -> None:
        pass


def _sent(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in BLOCK.split(", ")]
    while sent := list(islice(rows, SENT)):
        yield pd.DataFrame(sent, columns=names)


def whole_documents(blocks: DataFrame, moment: str = "seen_at", delay: str = "1 hour", wait: timedelta = timedelta(days=1), shelves: int = SHELVES) -> DataFrame:
    """Streamed blocks (document_id, page, position, text, is_table, blocks, and the event time ``moment``) of whole documents.

    Blocks that arrive behind the watermark are taken too: they may be what an open document waits for.
    """
    use_rocksdb(blocks.sparkSession)
    millis = F.coalesce(F.unix_millis(F.col(moment).cast("timestamp")), F.lit(0)).alias("moment")
    shelf = F.pmod(F.xxhash64("document_id"), F.lit(shelves)).cast("int").alias("shelf")
    rows = blocks.select(shelf, "document_id", "page", "position", "text", "is_table", "blocks", millis, F.col(moment).alias("seen")).withWatermark("seen", delay)
    return rows.groupBy("shelf").transformWithStateInPandas(OpenDocuments(wait), BLOCK, "append", "EventTime")


# --- silent sources --------------------------------------------------------------------------------------

SILENCE = "source string, silent_from timestamp, silent_to timestamp"


class SilentSources(StatefulProcessor):
    """Each source reports its own silence; there is one number and one timer a source, whatever the number of events.

    A gap between two events of more than ``width`` is a silence. The last event sets a timer for the time at
    which the source will have been silent for ``width``; when the watermark passes it, the silence is reported as open (no
    end), and once more with its end when the source speaks again. Events behind the newest one close nothing.
    """

    def __init__(self, width: timedelta):
        self.width = _milliseconds(width)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "newest long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, timer = self.last.get() if self.last.exists() else (None, None)
        # a key's rows come in parts and out of order; what is held are spans without a silence, no more than the time
        # they cover has widths
        spans: list[tuple[int, int]] = []
        for batch in rows:
            moments = np.sort(batch["moment"].to_numpy(np.int64))
            breaks = np.flatnonzero(np.diff(moments) > self.width)
            firsts, lasts = moments[np.concatenate([[0], breaks + 1])], moments[np.concatenate([breaks, [len(moments) - 1]])]
            spans = self._merged(sorted([*spans, *zip(firsts.tolist(), lasts.tolist(), strict=True)]))
        found = []
        for first, last in spans:
            if newest is None or last > newest:
                if newest is not None and first - newest > self.width:
                    found.append((key[0], newest, first))
                newest = last
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = newest + self.width
        self.handle.registerTimer(timer)
        self.last.update((newest, timer))
        if found:
            yield self._rows(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, _ = self.last.get()
        self.last.update((newest, None))
        yield self._rows([(key[0], newest, None)])

    def _merged(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out = spans[:1]
        for first, last in spans[1:]:
            if first - out[-1][1] <= self.width:
                out[-1] = (out[-1][0], max(out[-1][1], last))
            else:
                out.append((first, last))
        return out

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["source", "silent_from", "silent_to"])
        for name in ("silent_from", "silent_to"):
            out[name] = pd.to_datetime(out[name].astype("Int64").astype("float64"), unit="ms")
        return out

    def close(self) -> None:
        pass


def silent_sources(events: DataFrame, moment: str, source: str, width: timedelta = timedelta(hours=24), delay: str = "1 hour") -> DataFrame:
    """``source, silent_from, silent_to`` of a stream of events; an open silence has no end yet."""
    use_rocksdb(events.sparkSession)
    at = F.col(moment)
    rows = events.select(F.col(source).alias("source"), at.alias(moment), F.unix_millis(at.cast("timestamp")).alias("moment")).withWatermark(moment, delay)
    return rows.groupBy("source").transformWithStateInPandas(SilentSources(width), SILENCE, "append", "EventTime")
