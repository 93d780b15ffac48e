"""A folder may hold many frames, and many folders with one frame each share tasks."""

import json

from tessella.sources import readers


def line(seq, predicted=False, **more):
    return json.dumps({"stroke_id": 1, "seq": seq, "x": seq, "y": 0, "t": 0.5, "radius": 0, "predicted": predicted} | more)


def write(root, folder, *lines):
    (root / folder).mkdir(parents=True)
    (root / folder / "part.json").write_text("\n".join(lines))


def rows(reader, task):
    return [tuple(r[c] for c in ("frame", "place", "seq", "pressure")) for batch in reader.read(task) for r in batch.to_pylist()]


def test_folders_of_many_frames(tmp_path):
    write(tmp_path, "frames=0-1", line(1, True, frame=0), line(3, frame=1, pressure="NaN"), line(0, frame=0), line(2, True, frame=1))
    write(tmp_path, "frame=2", line(5), line(4))
    reader = readers.FrameReader(str(tmp_path))
    assert reader.latestOffset() == {"frames": 2}  # the third frame may still grow
    (tmp_path / "_SUCCESS").write_text("")
    assert reader.latestOffset() == {"frames": 3}
    (one, two) = reader.partitions({"frames": 0}, {"frames": 3})
    got = rows(reader, one)
    assert [r[:3] for r in got] == [(0, 0, 0), (0, 1, 1), (1, 0, 3), (1, 1, 2)]
    assert got[0][3] is None and got[2][3] != got[2][3]
    assert [r[:3] for r in rows(reader, two)] == [(2, 0, 4), (2, 1, 5)]
    assert reader.partitions({"frames": 2}, {"frames": 3}) == [two]


def test_many_frames_are_few_tasks(tmp_path):
    for n in range(600):
        write(tmp_path, f"frame={n}", line(n))
    reader = readers.FrameReader(str(tmp_path))
    tasks = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(tasks) < 10
    assert [r[2] for t in tasks for r in rows(reader, t)] == list(range(599))
