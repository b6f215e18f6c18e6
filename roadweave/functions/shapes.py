"""Shape kernels in plain numpy / Python, called from Arrow functions: triangles, overlap, crossings, closest pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from ..errors import GeometryError

Point = tuple[float, float]
EPS = 1e-9


def signed_area(ring: Sequence[Point]) -> float:
    """Counter-clockwise positive."""
    return 0.5 * sum(ring[i - 1][0] * ring[i][1] - ring[i][0] * ring[i - 1][1] for i in range(len(ring)))


def _cross(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def triangulate(ring: Sequence[Point]) -> list[tuple[int, int, int]]:
    """Ear clipping: index triples into the ring, counter-clockwise. Fewer than three points are an error."""
    n = len(ring)
    if n < 3:
        raise GeometryError("a ring needs three points")
    left = list(range(n)) if signed_area(ring) >= 0 else list(range(n - 1, -1, -1))
    out = []
    while len(left) > 3:
        for k in range(len(left)):
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
            a, b, c = ring[i], ring[j], ring[m]
            turn = _cross(a, b, c)
            if turn < 0:
                continue
            if turn <= EPS * EPS:  # three in a row: nothing to cut off
                left.pop(k)
                break
            if any(p not in (i, j, m) and ring[p] not in (a, b, c) and _cross(a, b, ring[p]) >= 0 and _cross(b, c, ring[p]) >= 0 and _cross(c, a, ring[p]) >= 0 for p in left):
                continue
            out.append((i, j, m))
            left.pop(k)
            break
        else:
            raise GeometryError("the ring crosses itself")
    if len(left) == 3 and abs(_cross(*(ring[i] for i in left))) > EPS * EPS:
        out.append(tuple(left))  # type: ignore[arg-type]
    return out


def convex_partition(ring: Sequence[Point]) -> list[list[int]]:
    """Triangles merged across shared edges while they stay convex: index rings, counter-clockwise."""
    parts: list[list[int]] = [list(t) for t in triangulate(ring)]

    def convex(p: list[int]) -> bool:
        return all(_cross(ring[p[i - 2]], ring[p[i - 1]], ring[p[i]]) >= -EPS for i in range(len(p)))

    merged = True
    while merged:
        merged = False
        for a in range(len(parts)):
            for b in range(a + 1, len(parts)):
                p, q = parts[a], parts[b]
                for i in range(len(p)):
                    u, v = p[i - 1], p[i]
                    if u in q and v in q and q[q.index(v) - len(q) + 1] == u:
                        j = q.index(u)
                        rest = [q[(j + k) % len(q)] for k in range(1, len(q) - 1)]
                        new = p[:i] + rest + p[i:]
                        if len(set(new)) == len(new) and convex(new):
                            parts[a] = new
                            parts.pop(b)
                            merged = True
                            break
                if merged:
                    break
            if merged:
                break
    return parts


def clip(subject: list[Point], window: list[Point]) -> list[Point]:
    """A convex part of subject inside the convex, counter-clockwise window."""
    out = subject
    for i in range(len(window)):
        a, b = window[i - 1], window[i]
        src, out = out, []
        for k in range(len(src)):
            p, q = src[k - 1], src[k]
            sp, sq = _cross(a, b, p), _cross(a, b, q)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                out.append((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
            if sq >= 0:
                out.append(q)
        if not out:
            return []
    return out


def overlap_area(a: Sequence[Point], b: Sequence[Point]) -> float:
    """Area that two simple rings share."""
    total = 0.0
    ta = [[a[i] for i in t] for t in triangulate(a)]
    tb = [[b[i] for i in t] for t in triangulate(b)]
    for x in ta:
        for y in tb:
            if min(p[0] for p in x) < max(p[0] for p in y) and max(p[0] for p in x) > min(p[0] for p in y) and min(p[1] for p in x) < max(p[1] for p in y) and max(p[1] for p in x) > min(p[1] for p in y):
                got = clip(x, y)
                if len(got) > 2:
                    total += abs(signed_area(got))
    return total


def overlaps(a: Sequence[Point], b: Sequence[Point]) -> bool:
    """Whether the interiors meet; a shared border alone is no overlap."""
    if len(a) < 3 or len(b) < 3:
        return False
    size = max(abs(signed_area(a)), abs(signed_area(b)), EPS)
    return overlap_area(a, b) > 1e-9 * size


def crossing(p: Point, q: Point, r: Point, s: Point) -> Point | None:
    """Where two segments meet; of overlapping ones, an end that lies on the other."""
    d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
    if abs(d) < 1e-12:
        for x, u, v in ((r, p, q), (s, p, q), (p, r, s), (q, r, s)):
            if abs(_cross(u, v, x)) < EPS and min(u[0], v[0]) - EPS <= x[0] <= max(u[0], v[0]) + EPS and min(u[1], v[1]) - EPS <= x[1] <= max(u[1], v[1]) + EPS:
                return x
        return None
    t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / d
    u = ((r[0] - p[0]) * (q[1] - p[1]) - (r[1] - p[1]) * (q[0] - p[0])) / d
    if -EPS <= t <= 1 + EPS and -EPS <= u <= 1 + EPS:
        return (p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t)
    return None


def _boxes(segments: Sequence[tuple]) -> list[tuple[list, list]]:
    return [([*map(min, p, q)], [*map(max, p, q)]) for p, q in segments]


def _gap(a: tuple[list, list], b: tuple[list, list]) -> float:
    """Square of the distance of two boxes."""
    out = 0.0
    for lo, hi, other, top in zip(*a, *b):  # noqa: B905  all have as many axes
        d = other - hi if other > hi else lo - top
        if d > 0:
            out += d * d
    return out


def _apart(a: Sequence[Point], b: Sequence[Point]) -> Callable[[int, int], bool]:
    """Of segments i of a and j of b: whether they are too far apart to meet, by crossing()'s tolerance and more."""
    sa, sb = _boxes([*zip(a, a[1:])]), _boxes([*zip(b, b[1:])])  # noqa: B905
    near = 1e-16 * (1 + sum(math.dist(*x) for x in (*sa, *sb))) ** 2
    return lambda i, j: _gap(sa[i], sb[j]) > near


def lines_meet(a: Sequence[Point], b: Sequence[Point]) -> bool:
    """Whether crossings() has any."""
    apart = _apart(a, b)
    return any(not apart(i, j) and crossing(a[i], a[i + 1], b[j], b[j + 1]) is not None for i in range(len(a) - 1) for j in range(len(b) - 1))


def crossings(a: Sequence[Point], b: Sequence[Point]) -> list[Point]:
    """Points where two polylines meet, in the first's order, each once."""
    out: list[Point] = []
    apart = _apart(a, b)
    for i in range(len(a) - 1):
        found = []
        for j in range(len(b) - 1):
            if apart(i, j):
                continue
            x = crossing(a[i], a[i + 1], b[j], b[j + 1])
            if x is not None:
                found.append(x)
        for x in sorted(found, key=lambda x, i=i: math.dist(a[i], x)):
            if not any(math.dist(x, y) < 1e-8 for y in out):
                out.append(x)
    return out


def _nearest_on(p: Sequence[float], a: Sequence[float], b: Sequence[float]) -> tuple[float, ...]:
    d = [y - x for x, y in zip(a, b, strict=True)]
    size = sum(x * x for x in d)
    t = 0.0 if size == 0 else max(0.0, min(1.0, sum((x - y) * z for x, y, z in zip(p, a, d, strict=True)) / size))
    return tuple(x + z * t for x, z in zip(a, d, strict=True))


def closest_pair(a: Sequence[Sequence[float]], b: Sequence[Sequence[float]]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The nearest points of two polylines, in two or three dimensions."""
    if not a or not b:
        raise GeometryError("a line without points has no nearest point")
    best: tuple = (math.inf, None, None)
    sa = list(zip(a, a[1:], strict=False)) or [(a[0], a[0])]
    sb = list(zip(b, b[1:], strict=False)) or [(b[0], b[0])]
    boxes = _boxes(sb)
    for (p, q), box in zip(sa, _boxes(sa), strict=True):
        for (r, s), other in zip(sb, boxes, strict=True):
            if _gap(box, other) > best[0] * best[0] * (1 + 1e-9):  # it can't come nearer
                continue
            tries = [(p, _nearest_on(p, r, s)), (q, _nearest_on(q, r, s)), (_nearest_on(r, p, q), r), (_nearest_on(s, p, q), s)]
            tries.append(_line_pair(p, q, r, s))
            for x, y in tries:
                d = math.dist(x, y)
                if d < best[0]:
                    best = (d, tuple(x), tuple(y))
            if best[0] == 0:
                return best[1], best[2]
    return best[1], best[2]


def _line_pair(p, q, r, s):
    """Nearest points of two segments' lines, clamped; of parallel ones, ends."""
    u, v, w = ([y - x for x, y in zip(m, n, strict=True)] for m, n in ((p, q), (r, s), (r, p)))
    dot = lambda m, n: sum(x * y for x, y in zip(m, n, strict=True))
    a, b, c, d, e = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    den = a * c - b * b
    if den < 1e-10:
        return p, _nearest_on(p, r, s)
    t = max(0.0, min(1.0, (b * e - c * d) / den))
    x = tuple(m + n * t for m, n in zip(p, u, strict=True))
    y = _nearest_on(x, r, s)
    return _nearest_on(y, p, q), y


def ring_distance(a: Sequence[Point], b: Sequence[Point]) -> float:
    """Between filled rings."""
    if overlaps(a, b):
        return 0.0
    x, y = closest_pair([*a, a[0]], [*b, b[0]])
    return math.dist(x, y)


def centreline(left: Sequence[Sequence[float]], right: Sequence[Sequence[float]]) -> list[tuple[float, ...]]:
    """Middle line of two bounds: two pointers, the side whose next rung is shorter and crosses no bound moves on. Empty where a bound is."""
    if not left or not right:
        return []
    mid = lambda p, q: tuple((x + y) / 2 for x, y in zip(p, q, strict=True))
    l2, r2 = [p[:2] for p in left], [p[:2] for p in right]

    def clear(a: Point, b: Point) -> bool:
        return all(not _proper(a, b, u, v) for line in (l2, r2) for u, v in zip(line, line[1:], strict=False))

    i = j = 0
    out = [mid(left[0], right[0])]
    while i < len(left) - 1 or j < len(right) - 1:
        tries = []
        if i < len(left) - 1:
            tries.append((math.dist(l2[i + 1], r2[j]), 0, i + 1, j))
        if j < len(right) - 1:
            tries.append((math.dist(l2[i], r2[j + 1]), 1, i, j + 1))
        tries.sort()
        _, _, i, j = next((t for t in tries if clear(l2[t[2]], r2[t[3]]) and clear(out[-1][:2], mid(left[t[2]], right[t[3]])[:2])), tries[0])
        p = mid(left[i], right[j])
        if math.dist(p, out[-1]) > 0:
            out.append(p)
    return out


def _proper(a: Point, b: Point, u: Point, v: Point) -> bool:
    """Whether two segments cross inside both."""
    return _cross(a, b, u) * _cross(a, b, v) < -EPS and _cross(u, v, a) * _cross(u, v, b) < -EPS


def shift(line: Sequence[Point], d: float) -> list[Point]:
    """Parallel line at d to the left: each vertex moves along the bisector of its segments' normals; where that turns a segment around, the offset segments' crossing is cut out."""
    if len(line) < 2:
        raise GeometryError("a line needs two points")
    normals = []
    for p, q in zip(line, line[1:], strict=False):
        n = math.dist(p, q)
        if n == 0:
            raise GeometryError("a segment has no direction")
        normals.append((-(q[1] - p[1]) / n, (q[0] - p[0]) / n))
    out: list[Point] = []
    for i, p in enumerate(line):
        a, b = normals[max(0, i - 1)], normals[min(i, len(normals) - 1)]
        s = 1 + a[0] * b[0] + a[1] * b[1]
        if s < 0.25:  # a sharp turn: one point for each segment
            out += [(p[0] + a[0] * d, p[1] + a[1] * d), (p[0] + b[0] * d, p[1] + b[1] * d)]
        else:
            out.append((p[0] + (a[0] + b[0]) * d / s, p[1] + (a[1] + b[1]) * d / s))
    return _without_loops(out)


def _without_loops(line: list[Point]) -> list[Point]:
    i = 0
    while i < len(line) - 1:
        for j in range(len(line) - 2, i + 1, -1):
            x = crossing(line[i], line[i + 1], line[j], line[j + 1])
            if x is not None and not (j == i + 1):
                line = [*line[: i + 1], x, *line[j + 1 :]]
                break
        i += 1
    return [p for k, p in enumerate(line) if k == 0 or math.dist(p, line[k - 1]) > 1e-9]


def offset(line: Sequence[Point], d: float) -> list[Point]:
    """As shift; an error where the result runs against the line."""
    out = shift(line, d)
    if len(out) < 2 or all((q[0] - p[0]) * (v[0] - u[0]) + (q[1] - p[1]) * (v[1] - u[1]) < -1e-7 for p, q in zip(line, line[1:], strict=False) for u, v in zip(out, out[1:], strict=False)):
        raise GeometryError("the offset turns the line around")
    return out


def meet(a: Sequence[Point], b: Sequence[Point]) -> bool:
    """Whether two filled rings share a point, borders included."""
    if not a or not b:
        return False
    if crossings([*a, a[0]], [*b, b[0]]):
        return True
    return _holds(a, b[0]) or _holds(b, a[0])


def _holds(ring: Sequence[Point], p: Point) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def height_at(line: Sequence[Sequence[float]], p: Sequence[float]) -> float:
    """z of a line in space where it is nearest to p seen from above."""
    best = (math.inf, 0.0)
    for a, b in list(zip(line, line[1:], strict=False)) or [(line[0], line[0])]:
        d = [b[0] - a[0], b[1] - a[1]]
        size = d[0] * d[0] + d[1] * d[1]
        t = 0.0 if size == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / size))
        far = math.hypot(a[0] + t * d[0] - p[0], a[1] + t * d[1] - p[1])
        if far < best[0] - 1e-12:
            best = (far, a[2] + t * (b[2] - a[2]))
    return best[1]


def gaps(a: Sequence[Sequence[float]], b: Sequence[Sequence[float]]) -> list[float]:
    """Differences in height of two lines in space where they cross seen from above."""
    return [abs(height_at(a, p) - height_at(b, p)) for p in crossings([x[:2] for x in a], [x[:2] for x in b])]


def height_gap(a: Sequence[Sequence[float]], b: Sequence[Sequence[float]]) -> float:
    """Difference in height of two rings' borders where they are nearest seen from above."""
    if not a or not b:
        return math.inf
    ra, rb = [*a, a[0]], [*b, b[0]]
    p, q = closest_pair([x[:2] for x in ra], [x[:2] for x in rb])
    return abs(height_at(ra, p) - height_at(rb, q))


def outline(rings: Sequence[Sequence[Sequence[float]]]) -> list[Sequence[float]]:
    """The ring around rings that touch in turn, clockwise: all segments but those that another ring has backwards."""
    turned = [list(r) if signed_area([p[:2] for p in r]) <= 0 else list(r)[::-1] for r in rings if r]
    if not turned:
        return []
    sides = [[(tuple(p), tuple(q)) for p, q in zip(r, [*r[1:], r[0]], strict=True) if tuple(p) != tuple(q)] for r in turned]
    for x, y in zip(sides, sides[1:], strict=False):
        back = {(q, p) for p, q in y}
        if not any(s in back for s in x):
            raise GeometryError("two members of the path share no border")
    count: dict = {}
    for ring in sides:
        for s in ring:
            count[s] = count.get(s, 0) + 1
    follow: dict = {}
    for (p, q), n in count.items():
        if n > count.get((q, p), 0):
            follow.setdefault(p, []).append(q)
    if not follow:
        return []
    start = next(p for p, _ in sides[0] if p in follow) if any(p in follow for p, _ in sides[0]) else next(iter(follow))
    out, at = [start], start
    while True:
        ways = follow.get(at)
        if not ways:
            raise GeometryError("the outline isn't closed")
        at = ways.pop(0)
        if at == start:
            return out
        out.append(at)
