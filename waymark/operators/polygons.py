"""Polygons cut into triangles by ear clipping (problem 5).

Vertices form a ring of links; only reflex vertices can lie in an ear, so only they are
looked up, in a grid over the polygon. Holes are tied to the outline by a bridge to the
edge on their right. Rings that cross themselves or each other have no ears to rely on:
they are cut into slabs between all their vertices and crossings, and the trapezoids with
an odd number of edges to their left are kept (even-odd rule).
"""

from __future__ import annotations

import math

import numpy as np

Point = tuple[float, float]
Triangle = tuple[Point, Point, Point]


def turn(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _area(ring: list[Point]) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) / 2


def _points(ring) -> list[Point]:
    """The ring open, without unknown points and repeats; nothing if fewer than three are left."""
    points: list[Point] = []
    for p in ring or []:
        if p is None or p[0] is None or p[1] is None or not (math.isfinite(p[0]) and math.isfinite(p[1])):
            continue
        if not points or points[-1] != (p[0], p[1]):
            points.append((p[0], p[1]))
    while len(points) > 1 and points[0] == points[-1]:
        points.pop()
    return points if len(points) >= 3 else []


def crossings(rings: list[list[Point]]) -> np.ndarray:
    """Points (n x 2) where two edges cross in their inside; a sweep over the edges' left ends."""
    a = np.array([p for r in rings for p in r], dtype=float)
    b = np.array([p for r in rings for p in r[1:] + r[:1]], dtype=float)
    order = np.argsort(np.minimum(a[:, 0], b[:, 0]), kind="stable")
    a, b = a[order], b[order]
    left, right = np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0])
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    reach = np.searchsorted(left, right, side="right")
    found = [np.zeros((0, 2))]
    at = 0
    while at < len(a):
        counts = np.maximum(reach[at:] - np.arange(at + 1, len(a) + 1), 0)
        upto = at + max(1, int(np.searchsorted(np.cumsum(counts), 1_000_000, side="right")))
        counts = counts[: upto - at]
        i = np.repeat(np.arange(at, upto), counts)
        j = i + 1 + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        near = (low[i] <= high[j]) & (low[j] <= high[i])
        i, j = i[near], j[near]
        side = lambda p, q, r: (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0])
        s, t, u, v = side(a[i], b[i], a[j]), side(a[i], b[i], b[j]), side(a[j], b[j], a[i]), side(a[j], b[j], b[i])
        cross = ((s < 0) != (t < 0)) & ((u < 0) != (v < 0)) & (s != 0) & (t != 0) & (u != 0) & (v != 0)
        i, f = i[cross], (u[cross] / (u[cross] - v[cross]))[:, None]
        found.append(a[i] + f * (b[i] - a[i]))
        at = upto
    return np.concatenate(found)


class _Reflex:
    """Vertices that may lie in an ear, in a grid over the polygon."""

    def __init__(self, ring: list[Point]):
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        cells = max(1, int(math.sqrt(len(ring))))
        self.x, self.y = min(xs), min(ys)
        self.width, self.height = (max(xs) - self.x) / cells or 1.0, (max(ys) - self.y) / cells or 1.0
        self.ring, self.cells, self.all = ring, {}, set()

    def _cell(self, p: Point) -> tuple[int, int]:
        return int((p[0] - self.x) / self.width), int((p[1] - self.y) / self.height)

    def add(self, i: int) -> None:
        self.all.add(i)
        self.cells.setdefault(self._cell(self.ring[i]), set()).add(i)

    def drop(self, i: int) -> None:
        self.all.discard(i)
        self.cells[self._cell(self.ring[i])].discard(i)

    def within(self, *corners: Point):
        (x0, y0), (x1, y1) = (self._cell((f(p[0] for p in corners), f(p[1] for p in corners))) for f in (min, max))
        if (x1 - x0 + 1) * (y1 - y0 + 1) >= len(self.all):
            return self.all
        return (i for x in range(x0, x1 + 1) for y in range(y0, y1 + 1) for i in self.cells.get((x, y), ()))


def _clip(ring: list[Point]) -> list[Triangle] | None:
    """Triangles of a counter-clockwise ring, or None if no ear is left before the end."""
    n = len(ring)
    after, before = [*range(1, n), 0], [n - 1, *range(n - 1)]
    bend = lambda i: turn(ring[before[i]], ring[i], ring[after[i]])
    reflex = _Reflex(ring)
    for i in range(n):
        if bend(i) <= 0:
            reflex.add(i)
    out: list[Triangle] = []
    at, idle = 0, 0
    while n > 3:
        a, b, c = ring[before[at]], ring[at], ring[after[at]]
        size = turn(a, b, c)
        blocked = size < 0 or size > 0 and any(
            turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0 for p in (ring[i] for i in reflex.within(a, b, c)) if p != a and p != b and p != c
        )
        if blocked:
            at, idle = after[at], idle + 1
            if idle > n:
                return None
            continue
        if size > 0:
            out.append((a, b, c))
        i, j = before[at], after[at]
        after[i], before[j] = j, i
        if at in reflex.all:
            reflex.drop(at)
        for v in (i, j):
            convex = bend(v) > 0
            if convex == (v in reflex.all):
                (reflex.drop if convex else reflex.add)(v)
        n, idle, at = n - 1, 0, after[j]  # every other corner, which keeps triangles from getting thin
    last = (ring[before[at]], ring[at], ring[after[at]])
    return out + [last] if turn(*last) > 0 else out


def _sees(ring: list[Point], i: int, m: Point) -> bool:
    """Whether the corner at ``i`` opens towards ``m``."""
    a, p, b = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
    sides = turn(a, p, m) >= 0, turn(p, b, m) >= 0
    return all(sides) if turn(a, p, b) > 0 else any(sides)


def _bridge(ring: list[Point], hole: list[Point]) -> list[Point] | None:
    """One ring of both, joined by a segment from the hole's rightmost point; None if nothing lies there."""
    j = max(range(len(hole)), key=lambda v: hole[v])
    m = hole[j]
    hit, end = math.inf, None
    for p, q in zip(ring, ring[1:] + ring[:1]):
        if p[1] <= m[1] <= q[1] and p[1] < q[1]:
            x = p[0] + (q[0] - p[0]) * (m[1] - p[1]) / (q[1] - p[1])
            if m[0] <= x < hit:
                hit, end = x, max(p, q)
    if end is None:
        return None
    corner = (hit, m[1])
    low, high = (m, corner) if end[1] >= m[1] else (corner, m)
    between = {p for p in ring if p[0] >= m[0] and turn(low, high, p) >= 0 and turn(high, end, p) >= 0 and turn(end, low, p) >= 0} | {end}
    best = min(between, key=lambda p: (abs(p[1] - m[1]) / (p[0] - m[0]) if p[0] > m[0] else math.inf, math.dist(p, m)))
    at = [i for i, p in enumerate(ring) if p == best]
    i = next((i for i in at if _sees(ring, i, m)), at[0])
    return ring[: i + 1] + hole[j:] + hole[: j + 1] + ring[i:]


def even_odd(rings: list[list[Point]], crossing: np.ndarray) -> list[Triangle]:
    """Triangles of the points that an odd number of edges separates from the outside."""
    a = np.array([p for r in rings for p in r], dtype=float)
    b = np.array([p for r in rings for p in r[1:] + r[:1]], dtype=float)
    level = a[:, 1] == b[:, 1]
    a, b = a[~level], b[~level]
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    heights = np.unique(np.concatenate([low, high, crossing[:, 1]]))
    slope = (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    out: list[Triangle] = []
    for y0, y1 in zip(heights[:-1], heights[1:]):
        mine = np.flatnonzero((low <= y0) & (high >= y1))
        x = lambda y: a[mine, 0] + slope[mine] * (y - a[mine, 1])
        order = np.argsort(x((y0 + y1) / 2), kind="stable")
        x0, x1 = x(y0)[order], x(y1)[order]
        for i in range(0, len(order) - 1, 2):
            p, q, r, s = (x0[i], y0), (x0[i + 1], y0), (x1[i + 1], y1), (x1[i], y1)
            out += [tuple((float(x), float(y)) for x, y in t) for t in ((p, q, r), (p, r, s)) if turn(*t) > 0]
    return out


def ear_clip(rings) -> list[Triangle]:
    """Triangles (counter-clockwise) of a polygon: the first ring is the outline, the others are holes.

    Rings may be closed or open and of either direction; null points, repeated points and
    rings of fewer than three points are ignored, a polygon without outline has no
    triangles. Nothing is lost where rings cross: they are read by the even-odd rule.
    """
    if not rings or not (outline := _points(rings[0])):
        return []
    all_ = [outline, *[p for p in map(_points, rings[1:]) if p]]
    met = crossings(all_)
    if not len(met) and _area(outline):
        ring: list[Point] | None = outline if _area(outline) > 0 else outline[::-1]
        holes = [h[::-1] if _area(h) > 0 else h for h in all_[1:] if _area(h)]
        for hole in sorted(holes, key=lambda h: -max(h)[0]):
            ring = ring and _bridge(ring, hole)
        if ring and (found := _clip(ring)) is not None:
            return found
    return even_odd(all_, met)


def clip_convex(corners: np.ndarray) -> np.ndarray:
    """Ear clipping of many convex polygons (n x m x 2, counter-clockwise) at once: n x (m - 2) x 3 x 2.

    Every corner of a convex polygon is an ear, so the first is cut until a triangle is left.
    """
    rest, out = corners, []
    while rest.shape[1] > 3:
        out.append(rest[:, [-1, 0, 1]])
        rest = rest[:, 1:]
    return np.stack([*out, rest], axis=1)
