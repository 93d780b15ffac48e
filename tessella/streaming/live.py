"""Keyed streams that answer by event time: state on change, idle hints, throttled progress.

Rows of a key are applied in the order of their numbers, once the watermark has passed their time; until then they
wait in the state. So batches may be repeated or come in another order, as far as the watermark waits, and the output
is the same: a row that waits or has been applied already counts once. Timers are in event time, so a replay
gives what the live stream gave. Numbers grow with time inside a key.

Every access of the state is a call to the JVM, so keys share a bucket with some others, whose waiting rows are read and
written together, and what a key has by numbers is kept in pages.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessella.operators.documents import IDLE_SECONDS

#: Progress is told once in so many milliseconds.
FLUSH_MS = 500
_NEVER = 1 << 62
#: Keys are dealt to so many buckets; the waiting rows of a bucket are kept by spans of so many milliseconds.
BUCKETS, SPAN_MS = 2048, 3_600_000
#: Neighbouring numbers of a key that are read and written together.
PAGE = 256


class Held:
    """A map state whose entries are read once and written back once for a stretch of rows: every access of the state is a call to the JVM."""

    def __init__(self, state):
        self.state = state
        self.forget()

    def forget(self) -> None:
        """Another key comes: nothing is known of its state."""
        self.now: dict[tuple, tuple | None] = {}
        self.there: set[tuple] = set()
        self.changed: set[tuple] = set()

    def _look(self, key: tuple) -> tuple | None:
        if key not in self.now:
            found = self.state.containsKey(key)
            self.now[key] = tuple(self.state.getValue(key)) if found else None
            if found:
                self.there.add(key)
        return self.now[key]

    def containsKey(self, key: tuple) -> bool:
        return self._look(key) is not None

    def getValue(self, key: tuple) -> tuple:
        return self._look(key)

    def updateValue(self, key: tuple, value: tuple) -> None:
        self._look(key)
        self.now[key] = value
        self.changed.add(key)

    def removeKey(self, key: tuple) -> None:
        self._look(key)
        self.now[key] = None
        self.changed.add(key)

    def load(self) -> None:
        """Reads the whole map, for one whose values or absence are asked for often."""
        for key, value in self.state.iterator():
            key = tuple(key)
            if key not in self.now:
                self.now[key] = tuple(value)
                self.there.add(key)

    def values(self) -> list[tuple]:
        return [v for v in self.now.values() if v is not None]

    def write(self) -> None:
        for key in self.changed:
            if self.now[key] is not None:
                self.state.updateValue(key, self.now[key])
            elif key in self.there:
                self.state.removeKey(key)
        self.forget()


class Pages:
    """Numbers and their rows for the key whose turn it is, kept in pages that are read once and written back once."""

    def __init__(self, state):
        self.held, self.key = Held(state), ""
        self.forget()

    def forget(self) -> None:
        self.held.forget()
        self.now: dict[tuple, dict[int, tuple]] = {}
        self.changed: set[tuple] = set()

    def _page(self, number: int) -> tuple[tuple, dict[int, tuple]]:
        spot = (self.key, number // PAGE)
        if spot not in self.now:
            rows = json.loads(self.held.getValue(spot)[0]) if self.held.containsKey(spot) else []
            self.now[spot] = {n: tuple(row) for n, row in rows}
        return spot, self.now[spot]

    def containsKey(self, key: tuple) -> bool:
        return key[0] in self._page(key[0])[1]

    def getValue(self, key: tuple) -> tuple:
        return self._page(key[0])[1][key[0]]

    def updateValue(self, key: tuple, value: tuple) -> None:
        spot, page = self._page(key[0])
        page[key[0]] = value
        self.changed.add(spot)

    def removeKey(self, key: tuple) -> None:
        spot, page = self._page(key[0])
        del page[key[0]]
        self.changed.add(spot)

    def write(self) -> None:
        for spot in self.changed:
            if self.now[spot]:
                self.held.updateValue(spot, (json.dumps(list(self.now[spot].items())),))
            else:
                self.held.removeKey(spot)
        self.held.write()
        self.forget()


class InOrder(StatefulProcessor):
    """Rows with ``at_ms``, ``seq``, the ``name`` of their key and the columns ``TAKES``; a subclass applies one at a time.

    A call has the rows of a bucket of keys. The states of keys are those of the subclass, one for each key.
    """

    TAKES: tuple[str, ...] = ()
    OUT: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, []
        self.waiting = handle.getMapState("waiting", "span long", "rows string")
        self.known = handle.getMapState("known", "name string", "json string")
        self.due_at = handle.getValueState("dues", "json string")
        self.prepare(handle)

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        """Further state of the subclass."""

    def hold(self, label: str) -> Pages:
        """Rows by number for each key, written back after every span of rows."""
        self.held.append(Pages(self.handle.getMapState(label, "name string, page long", "rows string")))
        return self.held[-1]

    def apply(self, state: dict, at: int, seq: int, row: list) -> Iterator[tuple]:
        """Changes the state; yields rows without the key."""
        raise NotImplementedError

    def passed(self, state: dict, now: int) -> Iterator[tuple]:
        """What is due by ``now`` with no further row before it."""
        return iter(())

    def due(self, state: dict) -> int:
        """The next time at which ``passed`` has something to do."""
        return _NEVER

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            spans: dict[int, dict] = {}
            columns = [frame[c].tolist() for c in ("at_ms", "seq", "name", *self.TAKES)]
            for at, seq, name, *row in zip(*columns):
                spans.setdefault(int(at) // SPAN_MS, {})[int(at), int(seq), name] = row
            for span, new in spans.items():
                if self.waiting.containsKey((span,)):
                    new = {(at, seq, name): row for at, seq, name, row in json.loads(self.waiting.getValue((span,))[0])} | new
                self._wait(span, [(*spot, row) for spot, row in new.items()])
        yield from self._advance(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(timerValues)

    def _wait(self, span: int, rows: list) -> None:
        self.waiting.updateValue((span,), (json.dumps(rows),))

    def _state(self, states: Held, name: str) -> dict:
        """The state of a key, whose turn it is now."""
        for held in self.held:
            held.key = name
        if not states.containsKey((name,)):
            return {"applied": -1}
        found = states.getValue((name,))[0]
        if isinstance(found, str):
            found = json.loads(found)
            states.now[(name,)] = (found,)
        return found

    def _advance(self, timers) -> Iterator[pd.DataFrame]:
        """A span of waiting rows at a time, so no more than one is held."""
        now, following = timers.getCurrentWatermarkInMs(), _NEVER
        dues = json.loads(self.due_at.get()[0]) if self.due_at.exists() else {}
        dues_before, states = dict(dues), Held(self.known)
        for (span,) in sorted(tuple(k) for k in self.waiting.keys()):
            rows, out = sorted(json.loads(self.waiting.getValue((span,))[0]), key=lambda r: r[:3]), []
            ready = [r for r in rows if r[0] <= now]
            for at, seq, name, row in ready:
                state = self._state(states, name)
                if seq > state["applied"]:
                    out += [(name, told) for told in self.passed(state, at)]
                    out += [(name, told) for told in self.apply(state, at, seq, row)]
                    state["applied"] = seq
                    states.updateValue((name,), (state,))
                    dues[name] = self.due(state)
            if ready:
                self._write(states)
                yield from self._rows(out)
                if len(ready) == len(rows):
                    self.waiting.removeKey((span,))
                else:
                    self._wait(span, rows[len(ready) :])
            if len(ready) < len(rows):
                following = rows[len(ready)][0]
                break
        out = []
        for name in [n for n, due in dues.items() if due <= now]:
            state = self._state(states, name)
            out += [(name, told) for told in self.passed(state, now)]
            states.updateValue((name,), (state,))
            dues[name] = self.due(state)
        self._write(states)
        dues = {name: due for name, due in dues.items() if due != _NEVER}
        if dues != dues_before:
            self.due_at.update((json.dumps(dues),))
        following = min([following, *dues.values()])
        set_already = list(self.handle.listTimers())
        if following != _NEVER and following not in set_already:
            self.handle.registerTimer(following)
        for timer in set_already:
            if timer != following and timer > now:
                self.handle.deleteTimer(timer)
        yield from self._rows(out)

    def _write(self, states: Held) -> None:
        for key in states.changed:
            states.now[key] = (json.dumps(states.now[key][0]),)
        states.write()
        for held in self.held:
            held.write()

    def _rows(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            rows = [(*json.loads(name).values(), *told) for name, told in out]
            yield pd.DataFrame(rows, columns=list(self.OUT), dtype=object)

    def close(self) -> None:
        pass


class StateChanges(InOrder):
    """Last colour and number of coloured regions of a document, told only when one of them differs."""

    TAKES = ("region_id", "color")
    OUT = ("doc_id", "seq", "color", "colored")
    SCHEMA = "doc_id long, seq long, color long, colored long"

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.palette = self.hold("palette")

    def apply(self, state, at, seq, row):
        region, color = row
        colored = state.get("colored", 0) + (not self.palette.containsKey((region,)))
        self.palette.updateValue((region,), (color,))
        told = [color, colored]
        state["colored"] = colored
        if state.get("told") != told:
            state["told"] = told
            yield (seq, color, colored)


class IdleHints(InOrder):
    """A hint when all regions are coloured and more than ``IDLE_SECONDS`` have passed since the last operation.

    Takes ``kind`` (``fill`` or ``undo``), the region and the document's number of regions. An undo takes the last
    fill back, and does nothing where there is none.
    """

    TAKES = ("kind", "region_id", "total")
    OUT = ("doc_id", "seq", "hint_ms")
    SCHEMA = "doc_id long, seq long, hint_ms long"

    def __init__(self, idle_ms: int = int(IDLE_SECONDS * 1000)):
        self.idle_ms = idle_ms

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.log = self.hold("log")
        self.fills = self.hold("fills")

    def apply(self, state, at, seq, row):
        kind, region, total = row
        length, colored = state.get("length", 0), state.get("colored", 0)
        step = 1
        if kind == "undo":
            step = -1 if length else 0
            if step:
                region = self.log.getValue((length - 1,))[0]
                self.log.removeKey((length - 1,))
        else:
            self.log.updateValue((length,), (region,))
        if step:
            before = self.fills.getValue((region,))[0] if self.fills.containsKey((region,)) else 0
            self.fills.updateValue((region,), (before + step,))
            colored += (before + step > 0) - (before > 0)
        state |= {"length": length + step, "colored": colored, "at": at, "seq": seq, "open": colored >= total}
        return iter(())

    def passed(self, state, now):
        if state.get("open") and now > state["at"] + self.idle_ms:
            state["open"] = False
            yield (state["seq"], state["at"] + self.idle_ms)

    def due(self, state):
        return state["at"] + self.idle_ms + 1 if state.get("open") else _NEVER


class Progress(InOrder):
    """Covered pixels of a region from signed changes of tiles, told at the end of a period in which a tile changed.

    Keyed by document and region. A period in which all changes took each other back is not told.
    """

    TAKES = ("tile", "delta")
    OUT = ("doc_id", "region_id", "flush_ms", "covered", "dirty_tiles")
    SCHEMA = "doc_id long, region_id long, flush_ms long, covered long, dirty_tiles long"

    def __init__(self, every_ms: int = FLUSH_MS):
        self.every_ms = every_ms

    def apply(self, state, at, seq, row):
        tile, delta = row
        dirty = state.setdefault("dirty", {})  # all that changed since the last flush, and nothing else
        dirty[str(tile)] = dirty.get(str(tile), 0) + delta
        state["flush"] = (at // self.every_ms + 1) * self.every_ms
        return iter(())

    def passed(self, state, now):
        flush = state.get("flush")
        if flush is not None and now >= flush:
            changes = [d for d in state.pop("dirty").values() if d]
            state["flush"] = None
            state["covered"] = state.get("covered", 0) + sum(changes)
            if changes:
                yield (flush, state["covered"], len(changes))

    def due(self, state):
        return state["flush"] if state.get("flush") is not None else _NEVER


def by_event_time(events: DataFrame, keys: list[str], processor: InOrder, late: str) -> DataFrame:
    """Runs a processor over ``keys``, ``seq``, ``at`` (timestamp) and its columns; ``late`` is how long it waits for rows."""
    timed = events.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    return (
        timed.withColumn("name", name)
        .withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(BUCKETS)))
        .select("bucket", "name", "at", "at_ms", "seq", *processor.TAKES)
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=processor.SCHEMA, outputMode="Append", timeMode="EventTime"
        )
    )


def upsert_batch(batch: DataFrame, n: int, out: str) -> None:
    """Versions of documents, a folder per batch: a batch that runs again replaces its own."""
    batch.write.mode("overwrite").parquet(f"{out}/batch={n}")


def versions(rows: DataFrame, key: str = "doc_id", version: str = "seq") -> DataFrame:
    """The upserted rows, one per document and version."""
    return rows.drop("batch").dropDuplicates([key, version])
