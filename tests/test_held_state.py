"""State maps are asked once for an entry and told once."""

from tessella.streaming.live import Held


class Counted:
    def __init__(self, **rows):
        self.rows, self.calls = {(k,): v for k, v in rows.items()}, 0

    def containsKey(self, key):
        self.calls += 1
        return key in self.rows

    def getValue(self, key):
        self.calls += 1
        return self.rows[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.rows[key]

    def iterator(self):
        self.calls += 1
        return iter(list(self.rows.items()))


def test_many_accesses_are_few_calls():
    state = Counted(a=(1,), b=(2,))
    held = Held(state)
    for n in range(1000):
        assert held.containsKey(("a",)) and not held.containsKey(("d",))
        held.updateValue(("a",), (n,))
        held.updateValue(("c",), (held.getValue(("c",))[0] + 1 if held.containsKey(("c",)) else 1,))
    held.removeKey(("b",))
    held.updateValue(("e",), (1,))
    held.removeKey(("e",))
    assert sorted(held.values()) == [(999,), (1000,)]
    held.write()
    assert state.rows == {("a",): (999,), ("c",): (1000,)} and state.calls < 15
    held.load()
    assert sorted(held.values()) == [(999,), (1000,)]
    held.forget()
    assert held.values() == []
