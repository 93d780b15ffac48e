"""Keys of a bucket share their calls to the state, and answer as if each were alone."""

import json
import random

import pandas as pd

from tessella.streaming import live as SL


class Store:
    """States, timers and watermark in memory; counts the calls."""

    def __init__(self):
        self.maps, self.value, self.timers, self.now, self.calls = {}, None, set(), 0, 0

    def getMapState(self, label, *_):
        return Map(self, self.maps.setdefault(label, {}))

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def listTimers(self):
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return self.now


class Map:
    def __init__(self, store, rows):
        self.store, self.rows = store, rows

    def _count(self, got=None):
        self.store.calls += 1
        return got

    def containsKey(self, key):
        return self._count(key in self.rows)

    def getValue(self, key):
        return self._count(self.rows[key])

    def updateValue(self, key, value):
        self._count()
        self.rows[key] = value

    def removeKey(self, key):
        self._count()
        del self.rows[key]

    def keys(self):
        return self._count(iter(list(self.rows)))


def run(processor, batches, ends):
    """Output of a processor over batches, each with the watermark after it."""
    store, out = Store(), []
    processor.init(store)
    for rows, now in zip(batches, ends):
        store.now = now
        frame = pd.DataFrame(rows, columns=["at_ms", "seq", "name", *processor.TAKES])
        out += processor.handleInputRows((0,), iter([frame]), store)
        for timer in [t for t in store.timers if t <= now]:
            store.timers.discard(timer)
            out += processor.handleExpiredTimer((0,), store, None)
    return [tuple(r) for f in out for r in f.itertuples(index=False)], store.calls


def name(doc):
    return json.dumps({"doc_id": doc})


def events(n=6000, docs=(*range(40), None)):
    rng = random.Random(3)
    return [(1000 * i, i, name(rng.choice(docs)), rng.choice(["fill", "fill", "undo"]), i % 3, 3) for i in range(n)]


def test_a_bucket_answers_as_its_keys_alone():
    rows = events()
    batches = [rows[:3000], rows[2000:4500][::-1], rows[4000:], []]
    ends = [1_500_000, 3_000_000, 5_500_000, 99_000_000]
    got, calls = run(SL.IdleHints(), batches, ends)
    want, alone = [], 0
    for key in {r[2] for r in rows}:
        told, spent = run(SL.IdleHints(), [[r for r in b if r[2] == key] for b in batches], ends)
        want, alone = want + told, alone + spent
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len(got) > 100 and calls < len(rows) / 2


def test_state_changes_of_a_bucket():
    rng, rows = random.Random(4), []
    for i in range(4000):
        rows.append((1000 * i, i, name(rng.randrange(60)), i % 13, rng.randrange(3) * 60))
    got, calls = run(SL.StateChanges(), [rows[:2500], rows[1500:], []], [2_000_000, 3_900_000, 9_000_000])
    want, seen, told = [], {}, {}
    for _, seq, key, region, color in rows:
        seen.setdefault(key, set()).add(region)
        if told.get(key) != (color, len(seen[key])):
            told[key] = color, len(seen[key])
            want.append((json.loads(key)["doc_id"], seq, color, len(seen[key])))
    assert sorted(got) == sorted(want) and calls < len(rows) / 2


def test_pages_are_read_and_written_once():
    store = Store()
    pages = SL.Pages(store.getMapState("log"))
    for key in ("a", "b"):
        pages.key = key
        for n in range(1000):
            assert not pages.containsKey((n,))
            pages.updateValue((n,), (n * 2,))
        for n in range(300, 1000):
            pages.removeKey((n,))
    pages.write()
    assert store.calls < 30 and len(store.maps["log"]) == 4
    pages.key = "b"
    assert pages.getValue((299,)) == (598,) and not pages.containsKey((300,))
