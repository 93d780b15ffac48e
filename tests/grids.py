"""Small grids as pixel tables, and imperative restatements used as ground truth."""

import numpy as np

STEPS = ((-1, 0), (1, 0), (0, -1), (0, 1))


def neighbours(x, y, w, h):
    for dx, dy in STEPS:
        if 0 <= x + dx < w and 0 <= y + dy < h:
            yield x + dx, y + dy


def pixel_rows(grids, cast=int):
    return [
        (i, x, y, None if g[y][x] is None else cast(g[y][x]))
        for i, g in grids.items()
        for y in range(len(g))
        for x in range(len(g[0]))
    ]


def grow_and_merge(line, seeds, min_area):
    """Seed by seed flood, then merging in raster order; returns label grid, kept, collisions, on_line."""
    h, w = line.shape
    label = -np.ones((h, w), dtype=int)
    collisions, on_line = [], []
    for i, (x, y) in enumerate(seeds):
        if line[y, x]:
            on_line.append(i)
        elif label[y, x] >= 0:
            collisions.append((int(label[y, x]), i))
        else:
            todo = [(x, y)]
            label[y, x] = i
            while todo:
                p = todo.pop()
                for q in neighbours(*p, w, h):
                    if not line[q[1], q[0]] and label[q[1], q[0]] < 0:
                        label[q[1], q[0]] = i
                        todo.append(q)
    area = [int((label == i).sum()) for i in range(len(seeds))]
    seen, kept = set(), []
    for y in range(h):
        for x in range(w):
            if (x, y) in seen or line[y, x] or label[y, x] >= 0:
                continue
            block, todo = [], [(x, y)]
            seen.add((x, y))
            while todo:
                p = todo.pop()
                block.append(p)
                for q in neighbours(*p, w, h):
                    if q not in seen and not line[q[1], q[0]] and label[q[1], q[0]] < 0:
                        seen.add(q)
                        todo.append(q)
            if len(block) >= min_area:
                kept.append((len(block), x, y))
                continue
            visited, ring = set(block), list(block)
            while ring:
                hits, nxt = [], []
                for p in ring:
                    for q in neighbours(*p, w, h):
                        if q in visited:
                            continue
                        visited.add(q)
                        if label[q[1], q[0]] >= 0:
                            hits.append(int(label[q[1], q[0]]))
                        elif line[q[1], q[0]]:
                            nxt.append(q)
                if hits:
                    best = min(hits, key=lambda i: (-area[i], i))
                    for bx, by in block:
                        label[by, bx] = best
                    break
                ring = nxt
    return label, sorted(kept, key=lambda o: (-o[0], o[2], o[1])), collisions, on_line


def wave(label):
    """Synchronous 4-neighbour wave, lowest id first; returns labels, rounds."""
    label = label.copy()
    h, w = label.shape
    rounds = 0
    while True:
        new = {}
        for y in range(h):
            for x in range(w):
                if label[y, x] < 0:
                    near = [label[q[1], q[0]] for q in neighbours(x, y, w, h) if label[q[1], q[0]] >= 0]
                    if near:
                        new[(x, y)] = min(near)
        if not new:
            return label, rounds
        for (x, y), v in new.items():
            label[y, x] = v
        rounds += 1


def dilate(ids, alpha, areas, rounds=2):
    ids = np.array(ids)
    h, w = ids.shape
    line = np.array(alpha) >= 32
    done = ~line
    for _ in range(rounds):
        old, was = ids.copy(), done.copy()
        for y in range(h):
            for x in range(w):
                if was[y, x]:
                    continue
                near = [old[q[1], q[0]] for q in neighbours(x, y, w, h) if was[q[1], q[0]]]
                if near:
                    ids[y, x] = min(near, key=lambda i: (areas[i], i))
                    done[y, x] = True
    return ids
