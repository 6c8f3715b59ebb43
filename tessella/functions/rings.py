"""Rings of very large polygon records in bounded memory: measures in one pass over the points, holes by winding numbers in another.

Points come from a function ``read(first, n)``, by slices of SLICE at most. As shapefiles have it, clockwise rings (negative area)
are shells and counter-clockwise ones holes; rings of fewer than four points or without area are degenerate and left out.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from .overlay import ranges

SLICE = 1 << 18
#: Edges whose middles are tried in turn as a hole's probe.
ROUNDS = 3


class CorruptShape(ValueError):
    """The bytes aren't a shape record as the format has it."""


class AmbiguousHole(ValueError):
    """A hole lies in no shell, or all its probes lie on the border of one."""


@dataclass
class Rings:
    """Measures of a record's rings; ``probes`` are the first four vertices."""

    starts: np.ndarray
    sizes: np.ndarray
    areas: np.ndarray
    low: np.ndarray
    high: np.ndarray
    closed: np.ndarray
    probes: np.ndarray

    def usable(self) -> np.ndarray:
        return (self.sizes >= 4) & (self.areas != 0)

    def shells(self) -> np.ndarray:
        return np.flatnonzero(self.usable() & (self.areas < 0))

    def holes(self) -> np.ndarray:
        return np.flatnonzero(self.usable() & (self.areas > 0))

    def net_area(self) -> float:
        """Shells less holes; the sum is compensated."""
        total, carry = 0.0, 0.0
        for a in (-self.areas[self.sizes > 0]).tolist():
            grown = total + a
            carry += (total - grown) + a if abs(total) >= abs(a) else (a - grown) + total
            total = grown
        return total + carry


def measured(read, starts: np.ndarray, n_points: int) -> Rings:
    """One pass over the points. Areas are taken about each ring's first vertex, and slices' sums are added with compensation."""
    n = len(starts)
    if n and (starts[0] != 0 or (np.diff(starts) < 0).any() or starts[-1] > n_points):
        raise CorruptShape("parts don't stand in order")
    sizes = np.diff(np.append(starts, n_points))
    sums, carry, first, last = np.zeros(n), np.zeros(n), np.zeros((n, 2)), np.zeros((n, 2))
    low, high, probes = np.full((n, 2), np.inf), np.full((n, 2), -np.inf), np.zeros((n, 4, 2))
    filled = np.flatnonzero(sizes > 0)
    for at in range(0, n_points, SLICE):
        p = read(at, min(SLICE, n_points - at))
        place = np.arange(at, at + len(p))
        ring = filled[np.searchsorted(starts[filled], place, "right") - 1]
        nth = place - starts[ring]
        heads = np.flatnonzero(np.diff(ring, prepend=-1))
        own = ring[heads]
        new = nth == 0
        first[ring[new]] = p[new]
        rel = p - first[ring]
        before = np.concatenate([rel[:1], rel[:-1]])
        before[heads] = last[own]
        before[new] = 0
        terms = before[:, 0] * rel[:, 1] - rel[:, 0] * before[:, 1]
        part = np.add.reduceat(terms, heads) / 2
        grown = sums[own] + part
        carry[own] += np.where(np.abs(sums[own]) >= np.abs(part), (sums[own] - grown) + part, (part - grown) + sums[own])
        sums[own] = grown
        low[own], high[own] = np.minimum(low[own], np.minimum.reduceat(p, heads)), np.maximum(high[own], np.maximum.reduceat(p, heads))
        last[own] = rel[np.append(heads[1:], len(p)) - 1]
        some = nth < 4
        probes[ring[some], nth[some]] = p[some]
    return Rings(starts, sizes, sums + carry, low, high, (last == 0).all(1), probes)


def winding(read, start: int, size: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winding numbers of a ring about points in order of y, and whether each lies on the ring."""
    turns, border, held = np.zeros(len(x)), np.zeros(len(x), bool), None
    for at in range(start, start + size, SLICE):
        p = read(at, min(SLICE, start + size - at))
        p = p if held is None else np.concatenate([held, p])
        held = p[-1:]
        a, b = p[:-1], p[1:]
        low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
        for e, k in ranges(np.searchsorted(y, low, "left"), np.searchsorted(y, high, "right")):
            (x1, y1), (x2, y2) = a[e].T, b[e].T
            side = (x2 - x1) * (y[k] - y1) - (x[k] - x1) * (y2 - y1)
            on = (side == 0) & (x[k] >= np.minimum(x1, x2)) & (x[k] <= np.maximum(x1, x2))
            border[k[on]] = True
            up, down = (y1 <= y[k]) & (y2 > y[k]) & (side > 0), (y1 > y[k]) & (y2 <= y[k]) & (side < 0)
            turns += np.bincount(k[(up | down) & ~on], weights=np.where(up, 1, -1)[(up | down) & ~on], minlength=len(x))
    return turns.astype(np.int64), border


def assigned(read, rings: Rings) -> np.ndarray:
    """The smallest shell that holds each hole, -1 for other rings. A hole is told by the middle of its first edge; where that
    lies on a shell's border or in none, the second and third edges are tried."""
    out, holes, shells = np.full(len(rings.areas), -1), rings.holes(), rings.shells()
    shells = shells[np.argsort(-rings.areas[shells], kind="stable")]  # smallest first
    pending = holes
    for edge in range(ROUNDS):
        if not len(pending):
            break
        probe = (rings.probes[pending, edge] + rings.probes[pending, edge + 1]) / 2
        order = np.argsort(probe[:, 0], kind="stable")
        by_x = probe[order, 0]
        best, border = np.full(len(pending), -1), np.zeros(len(pending), bool)
        found: dict[int, list[np.ndarray]] = {}
        for s, k in ranges(np.searchsorted(by_x, rings.low[shells, 0], "left"), np.searchsorted(by_x, rings.high[shells, 0], "right")):
            y = probe[order[k], 1]
            fits = (y >= rings.low[shells[s], 1]) & (y <= rings.high[shells[s], 1])
            s, k = s[fits], order[k[fits]]
            cuts = np.flatnonzero(np.diff(s)) + 1
            for place, some in zip(s[np.concatenate([[0], cuts])].tolist() if len(s) else [], np.split(k, cuts)):
                found.setdefault(place, []).append(some)
        for place in sorted(found):
            k = np.concatenate(found[place])
            k = k[np.argsort(probe[k, 1], kind="stable")]
            turns, on = winding(read, int(rings.starts[shells[place]]), int(rings.sizes[shells[place]]), probe[k, 0], probe[k, 1])
            border[k[on]] = True
            take = k[(turns != 0) & ~on & (best[k] < 0)]
            best[take] = shells[place]
        out[pending] = best
        pending = pending[(best < 0) | border]
    if len(pending):
        lost = int((out[pending] < 0).sum())
        raise AmbiguousHole(f"{lost} holes lie in no shell and {len(pending) - lost} can't be told from a border, of {len(holes)}")
    return out


def polygon_ewkb(read, rings: Rings, members: list[int], srid: int | None) -> bytes:
    """Little-endian EWKB of a shell and its holes."""
    head = struct.pack("<BI", 1, 3 | (0x20000000 if srid else 0)) + (struct.pack("<I", srid) if srid else b"")
    body = [struct.pack("<I", int(rings.sizes[r])) + np.ascontiguousarray(read(int(rings.starts[r]), int(rings.sizes[r])), "<f8").tobytes() for r in members]
    return head + struct.pack("<I", len(members)) + b"".join(body)
