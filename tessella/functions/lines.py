"""Lines: length, distance of shapes at their vertices, the stretches of a line near other lines, comparable texts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np

#: Pairs of segments looked at together.
PAIRS = 1 << 18


def segments(geom: dict) -> np.ndarray:
    """(n, 4) of all parts, without those of no length."""
    found = [np.concatenate([p[:-1], p[1:]], 1) for part in geom["parts"] for r in part if len(p := np.asarray(r, float).reshape(-1, 2)) > 1]
    out = np.concatenate(found) if found else np.empty((0, 4))
    return out[(out[:, :2] != out[:, 2:]).any(1)]


def length(geom: dict) -> float:
    s = segments(geom)
    return float(np.hypot(*(s[:, 2:] - s[:, :2]).T).sum())


def vertex_distances(geom: dict, other: dict) -> np.ndarray:
    """Distance of each vertex to the other line."""
    p = np.concatenate([np.asarray(r, float).reshape(-1, 2) for part in geom["parts"] for r in part])
    s = segments(other)
    if not len(s):
        q = np.asarray(other["parts"][0][0][0], float)
        return np.hypot(*(p - q).T)
    out = np.empty(len(p))
    step = max(1, PAIRS // len(s))
    a, way = s[:, :2], s[:, 2:] - s[:, :2]
    for k in range(0, len(p), step):
        off = p[k : k + step, None] - a
        t = np.clip((off * way).sum(2) / (way**2).sum(1), 0, 1)
        out[k : k + step] = np.hypot(*np.moveaxis(off - t[..., None] * way, -1, 0)).min(1)
    return out


def hausdorff(a: dict, b: dict) -> float:
    """The greatest distance of a vertex of either line to the other line."""
    return float(max(vertex_distances(a, b).max(), vertex_distances(b, a).max()))


def _near(p: np.ndarray, way: np.ndarray, q: np.ndarray, r: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) as shares of the segments from p along way where they lie within reach of the segments from q to r; to is less than
    from where they don't. The last axes are x and y.

    What lies within reach of a segment is convex: the hull of two discs. So each pair gives one interval, from the least to the
    greatest place that the discs and the strip between them cover."""
    along = r - q
    size = np.hypot(along[..., 0], along[..., 1])
    shape = np.broadcast_shapes(p.shape, q.shape)[:-1]
    low, high = np.full(shape, np.inf), np.full(shape, -np.inf)

    def widen(a, b):
        a, b = np.maximum(a, 0), np.minimum(b, 1)
        some = a <= b
        low[some], high[some] = np.minimum(low, a)[some], np.maximum(high, b)[some]

    a2 = (way**2).sum(-1)
    for centre in (q, r):
        off = p - centre
        half, rest = (off * way).sum(-1), (off**2).sum(-1) - reach * reach
        root = half**2 - a2 * rest
        with np.errstate(invalid="ignore"):
            root = np.sqrt(np.where(root >= 0, root, np.nan))
        a, b = (-half - root) / a2, (-half + root) / a2
        widen(np.where(np.isnan(a), 2, a), np.where(np.isnan(b), -1, b))
    off = p - q
    start, end = np.full(shape, -np.inf), np.full(shape, np.inf)
    # Along the other segment between its ends, across it within reach: four half planes on one parameter.
    for c0, c1, most in (((off * along).sum(-1), (way * along).sum(-1), size**2), (off[..., 1] * along[..., 0] - off[..., 0] * along[..., 1] + reach * size, way[..., 1] * along[..., 0] - way[..., 0] * along[..., 1], 2 * reach * size)):
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y = -c0 / c1, (most - c0) / c1
        flat = c1 == 0
        inside = (c0 >= 0) & (c0 <= most)
        x, y = np.where(flat, np.where(inside, -np.inf, np.inf), np.minimum(x, y)), np.where(flat, np.where(inside, np.inf, -np.inf), np.maximum(x, y))
        start, end = np.maximum(start, x), np.minimum(end, y)
    widen(start, end)
    return low, high


def near_intervals(s: np.ndarray, others: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to) as shares of the segment's length where it lies within reach of one of the other segments."""
    rows, lows, highs = [], [], []
    step = max(1, PAIRS // max(1, len(others)))
    for k in range(0, len(s), step):
        low, high = _near(s[k : k + step, None, :2], (s[k : k + step, 2:] - s[k : k + step, :2])[:, None], others[:, :2], others[:, 2:], reach)
        i, j = np.nonzero(low <= high)
        rows.append(i + k)
        lows.append(low[i, j])
        highs.append(high[i, j])
    return tuple(np.concatenate(x) if x else np.empty(0) for x in (rows, lows, highs))


def covered(geom: dict, others: list[dict], reach: float) -> float:
    """Length of the line that lies within reach of any of the others: stretches are united along each segment."""
    s, o = segments(geom), [segments(g) for g in others]
    o = np.concatenate(o) if o else np.empty((0, 4))
    if not len(s) or not len(o):
        return 0.0
    row, low, high = near_intervals(s, o, reach)
    if not len(row):
        return 0.0
    size = np.hypot(*(s[:, 2:] - s[:, :2]).T)
    order = np.lexsort((low, row))
    row, low, high = row[order].astype(np.int64), low[order], high[order]
    heads = np.concatenate([[True], row[1:] != row[:-1]])
    # Ends run on within a segment: shares are shifted by twice the segment's number, which keeps segments apart.
    reached = np.maximum.accumulate(high + 2 * row)
    before = np.where(heads, low, np.concatenate([[0.0], reached[:-1]]) - 2 * row)
    return float((np.maximum(0, high - np.maximum(low, before)) * size[row]).sum())


def stacked(geoms: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All vertices and how many each geometry has, and all segments of some length and how many each has."""
    rings = [(k, r) for k, g in enumerate(geoms) for part in g["parts"] for r in part]
    n = np.array([len(r) for _, r in rings], np.int64)
    own = np.repeat(np.array([k for k, _ in rings], np.int64), n)
    p = np.fromiter(chain.from_iterable(chain.from_iterable(r for _, r in rings)), float).reshape(len(own), 2)
    starts = np.ones(len(p), bool)
    starts[np.cumsum(n) - 1] = False
    starts = np.flatnonzero(starts)
    s = np.concatenate([p[starts], p[starts + 1]], 1)
    some = (s[:, :2] != s[:, 2:]).any(1)
    return p, np.bincount(own, minlength=len(geoms)), s[some], np.bincount(own[starts[some]], minlength=len(geoms))


def _crossed(n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of the n[k] things of a group k and its m[k] others, group by group."""
    size = n * m
    group = np.repeat(np.arange(len(n)), size)
    at = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    return (np.cumsum(n) - n)[group] + at // m[group], (np.cumsum(m) - m)[group] + at % m[group]


def _runs(sizes: list[int]) -> Iterator[list[int]]:
    """Places of rows with about PAIRS together."""
    run, held = [], 0
    for k, size in enumerate(sizes):
        if run and held + size > PAIRS:
            yield run
            run, held = [], 0
        run.append(k)
        held += size
    if run:
        yield run


def _count(geom: dict) -> int:
    return sum(len(r) for part in geom["parts"] for r in part)


def _farthest(a: tuple, b: tuple) -> np.ndarray:
    """The greatest distance of a vertex of each of many geometries to the geometry that faces it, both stacked."""
    p, n, _, _ = a
    _, _, s, m = b
    i, j = _crossed(n, m)
    off, way = p[i] - s[j, :2], (s[:, 2:] - s[:, :2])[j]
    t = np.clip((off * way).sum(1) / (way**2).sum(1), 0, 1)
    apart = np.hypot(*(off - t[:, None] * way).T)
    each = np.repeat(m, n)
    return np.maximum.reduceat(np.minimum.reduceat(apart, np.cumsum(each) - each), np.cumsum(n) - n)


def hausdorffs(a: list[dict], b: list[dict]) -> list[float]:
    """``hausdorff`` of many pairs, small ones together."""
    out = np.empty(len(a))
    for run in _runs([2 * _count(x) * _count(y) for x, y in zip(a, b)]):
        left, right = stacked([a[k] for k in run]), stacked([b[k] for k in run])
        plain = (left[3] > 0) & (right[3] > 0)
        for k in np.asarray(run)[~plain]:
            out[k] = hausdorff(a[k], b[k])
        if not plain.all():
            run = np.asarray(run)[plain].tolist()
            left, right = stacked([a[k] for k in run]), stacked([b[k] for k in run])
        if len(run) == 1:
            out[run] = hausdorff(a[run[0]], b[run[0]])
        elif run:
            out[run] = np.maximum(_farthest(left, right), _farthest(right, left))
    return out.tolist()


def covers(geoms: list[dict], others: list[list[dict]], reach: float) -> list[float]:
    """``covered`` of many lines, each by others of its own, small ones together."""
    out = np.zeros(len(geoms))
    for run in _runs([_count(g) * sum(map(_count, several)) for g, several in zip(geoms, others)]):
        if len(run) == 1:
            out[run] = [covered(geoms[k], others[k], reach) for k in run]
            continue
        _, _, s, n = stacked([geoms[k] for k in run])
        _, _, o, each = stacked([g for k in run for g in others[k]])
        m = np.bincount(np.repeat(np.arange(len(run)), [len(others[k]) for k in run]), each, len(run)).astype(np.int64)
        i, j = _crossed(n, m)
        low, high = _near(s[i, :2], (s[:, 2:] - s[:, :2])[i], o[j, :2], o[j, 2:], reach)
        hit = np.flatnonzero(low <= high)
        hit = hit[np.lexsort((low[hit], i[hit]))]
        row, low, high = i[hit], low[hit], high[hit]
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
        count = np.diff(heads, append=len(row))
        heads, count = (x[np.argsort(-count, kind="stable")] for x in (heads, count))
        # The intervals of a segment one after the other, those of all segments together.
        found, reached = np.zeros(len(heads)), low[heads]
        for d in range(count[0] if len(count) else 0):
            at = heads[: np.searchsorted(-count, -d)] + d
            w = slice(0, len(at))
            found[w] += np.maximum(0, high[at] - np.maximum(low[at], reached[w]))
            reached[w] = np.maximum(reached[w], high[at])
        at = row[heads]
        size = np.hypot(*(s[at, 2:] - s[at, :2]).T)
        out[run] = np.bincount(np.repeat(np.arange(len(run)), n)[at], found * size, len(run))
    return out.tolist()


def joined(geom: dict) -> list[list[tuple]]:
    """Parts put together where exactly two ends meet."""
    chains = [[tuple(p) for p in r] for part in geom["parts"] for r in part if len(r) > 1]
    ends: dict[tuple, int] = {}
    for c in chains:
        for p in (c[0], c[-1]):
            ends[p] = ends.get(p, 0) + 1
    out: list[list[tuple]] = []
    todo = chains[::-1]
    while todo:
        chain, grown = todo.pop(), True
        while grown and chain[0] != chain[-1]:
            grown = False
            for k, other in enumerate(todo):
                for at_end in (True, False):
                    p = chain[-1] if at_end else chain[0]
                    if ends[p] == 2 and p in (other[0], other[-1]) and other[0] != other[-1]:
                        side = other if (other[0] == p) == at_end else other[::-1]
                        chain = chain + side[1:] if at_end else side[:-1] + chain
                        del todo[k]
                        grown = True
                        break
                if grown:
                    break
        out.append(chain)
    return out


def comparable(geom: dict, digits: int = 4) -> str:
    """A text that lines share if they run through the same rounded places, whatever their direction and parts."""
    whole = [[[(round(x * 10**digits), round(y * 10**digits)) for x, y in r] for r in part] for part in geom["parts"]]
    alone = len(whole) == 1 == len(whole[0]) and len(whole[0][0]) > 1
    chains = []
    for path in whole[0] if alone else joined({"parts": whole}):
        path = [p for k, p in enumerate(path) if not k or p != path[k - 1]]
        chains.append(min(path, path[::-1]))
    return ";".join(",".join(f"{x} {y}" for x, y in c) for c in sorted(chains))
