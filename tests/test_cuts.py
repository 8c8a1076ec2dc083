"""Routes against general polygons and exact buffers, held against plain geometry."""

import math
import random

import pytest

from terrascreen.operators import covers, cuts, linear, spatial

EDGES = "poly_id int, x1 double, y1 double, x2 double, y2 double"


def ring(poly_id, *points):
    return [(poly_id, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in zip(points, points[1:] + points[:1])]


def route(frame, *points, gid=1):
    return linear.route_segments(frame([(gid, i, float(x), float(y)) for i, (x, y) in enumerate(points, start=1)], "gid int, seq int, x double, y double"))


def to_edge(x, y, e):
    _, ax, ay, bx, by = e
    dx, dy = bx - ax, by - ay
    t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
    return math.hypot(x - ax - t * dx, y - ay - t * dy)


def inside(x, y, edges):
    return sum((ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax) for _, ax, ay, bx, by in edges) % 2 == 1


def covered(x, y, edges, distance):
    polygons = {}
    for e in edges:
        polygons.setdefault(e[0], []).append(e)
    return any(to_edge(x, y, e) <= distance + 1e-9 for e in edges) or any(inside(x, y, p) for p in polygons.values())


def plain_length(points, edges, distance):
    """Covered length: all places where it can change, then midpoints."""
    total, longest, open_since, walked = 0.0, 0.0, 0.0, 0.0
    for (px, py), (qx, qy) in zip(points, points[1:]):
        length = math.hypot(qx - px, qy - py)
        dx, dy = (qx - px) / length, (qy - py) / length
        spots = {0.0, length}
        for _, ax, ay, bx, by in edges:
            ex, ey = bx - ax, by - ay
            size = math.hypot(ex, ey)
            for side in {0.0, distance, -distance}:  # the edge and its two parallels
                ox, oy = ax - ey / size * side, ay + ex / size * side
                cross = dx * ey - dy * ex
                if abs(cross) > 1e-12:
                    spots.add(((ox - px) * ey - (oy - py) * ex) / cross)
            for cx, cy in ((ax, ay), (bx, by)):
                middle = (cx - px) * dx + (cy - py) * dy
                off = (cx - px) * dy - (cy - py) * dx
                half = math.sqrt(max(distance ** 2 - off ** 2, 0.0))
                spots |= {middle - half, middle + half}
        cut = sorted(s for s in spots if 0 <= s <= length)
        for a, b in zip(cut, cut[1:]):
            middle = (a + b) / 2
            if b - a > 1e-9 and covered(px + middle * dx, py + middle * dy, edges, distance):
                total += b - a
                longest = max(longest, walked + a - open_since)
                open_since = walked + b
        walked += length
    return total, max(longest, walked - open_since)


def shapes():
    """Concave, holed, touching, repeated and far polygons."""
    star = [(60 + (45 if k % 2 else 15) * math.cos(k * math.pi / 5), 50 + (45 if k % 2 else 15) * math.sin(k * math.pi / 5)) for k in range(10)]
    return (ring(1, *star) + ring(2, (100, 0), (220, 0), (220, 90), (100, 90)) + ring(2, (130, 20), (190, 20), (190, 70), (130, 70))
            + ring(3, (220, 0), (260, 0), (260, 90), (220, 90)) + ring(4, (-30, -40), (10, -35), (-10, 5), (-12, -20)) + ring(5, (-30, -40), (10, -35), (-10, 5), (-12, -20))
            + ring(6, (0, 200), (300, 210), (310, 214), (0, 204)))


LINES = [[(-50, 50), (300, 50)], [(-50, 0), (300, 0)], [(0, -60), (40, 120), (250, 30), (250, -20)], [(130, -10), (130, 100)], [(100, 90), (260, 90)],
         [(-40, 207), (320, 209)], [(500, 500), (501, 501)], [(150, 40), (160, 45)]]


@pytest.mark.parametrize("distance", [0.0, 3.0])
def test_general_polygons_hand_lines(frame, distance):
    edges = shapes()
    rows = [(g, i, float(x), float(y)) for g, line in enumerate(LINES) for i, (x, y) in enumerate(line)]
    segments = linear.route_segments(frame(rows, "gid int, seq int, x double, y double"))
    got = {r["gid"]: r for r in cuts.route_polygon_profile(segments, frame(edges, EDGES), distance_m=distance).collect()}
    for g, line in enumerate(LINES):
        overlap, gap = plain_length(line, edges, distance)
        assert got[g]["overlap_m"] == pytest.approx(overlap, abs=1e-6), line
        assert got[g]["longest_gap_m"] == pytest.approx(gap, abs=1e-6), line
        assert got[g]["reconciles"]


def test_random_polygons_and_buffers(frame, spark):
    rng = random.Random(8)
    edges = []
    for k in range(40):
        x, y, n = rng.uniform(-200, 400), rng.uniform(-200, 400), rng.randint(3, 12)
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        edges += ring(k, *[(x + rng.uniform(5, 70) * math.cos(a), y + rng.uniform(5, 70) * math.sin(a)) for a in angles])
    lines = {g: [(rng.uniform(-250, 450), rng.uniform(-250, 450)) for _ in range(4)] for g in range(12)}
    rows = [(g, i, x, y) for g, line in lines.items() for i, (x, y) in enumerate(line)]
    segments = linear.route_segments(frame(rows, "gid int, seq int, x double, y double"))
    got = {(r["gid"], r["buffer_m"]): (r["overlap_m"], r["longest_gap_m"]) for r in covers.buffered_lengths(segments, {"all": frame(edges, EDGES)}).collect()}
    assert len(got) == 36
    for g, line in lines.items():
        for buffer in covers.BUFFERS_M:
            assert got[g, buffer] == pytest.approx(plain_length(line, edges, buffer), abs=1e-6)


def test_no_cover_and_no_contact(frame):
    line = route(frame, (0, 0), (10, 0))
    for edges in ([], ring(1, (0, 50), (10, 50), (5, 60))):
        row = cuts.route_polygon_profile(line, frame(edges, EDGES)).first()
        assert (row["overlap_m"], row["longest_gap_m"]) == (0.0, 10.0)


def test_a_polygon_of_ten_thousand_tiles(frame, spark):
    """Rows laid out for a wide polygon grow with the logarithm of its width."""
    edges = frame(ring(1, (-3, -7), (500_000, -4), (500_002, 60), (250_000, 30), (1, 66)) + ring(2, (400_000, 0), (400_300, 0), (400_300, 300), (400_000, 300)), EDGES)
    rng = random.Random(2)
    points = [(i, rng.uniform(-100, 500_100), rng.uniform(-20, 80)) for i in range(400)]
    table = frame(points, "pid int, x double, y double")
    tiles = spatial.inside_polygons(table, ["pid"], edges)
    both = edges.collect()
    rings = [[tuple(r) for r in both if r["poly_id"] == k] for k in (1, 2)]
    assert {r["pid"] for r in tiles.collect()} == {i for i, x, y in points if any(inside(x, y, e) for e in rings)}
    corners = table.selectExpr("cast(floor(x / 50) as bigint) as tx", "cast(floor(y / 50) as bigint) as ty").distinct()
    laid = spatial._inside_corners(corners, edges, "poly_id", 50.0)
    assert laid.count() <= 2 * corners.count()


def test_points_at_tile_corners_and_piles(frame):
    edges = ring(1, (0, 0), (100, 0), (100, 100), (0, 100)) + ring(2, (50, 50), (150, 50), (150, 150), (50, 150)) + ring(3, (0, 0), (100, 0), (100, 100), (0, 100))
    points = [(i, x + 0.25, y + 0.25) for i, (x, y) in enumerate((x, y) for x in range(-50, 200, 25) for y in range(-50, 200, 25))] + [(1000 + i, 60.0, 60.0) for i in range(50)] + [(5000, None, 1.0)]
    found = {r["pid"] for r in spatial.inside_polygons(frame(points, "pid int, x double, y double"), ["pid"], frame(edges, EDGES)).collect()}
    wanted = {i for i, x, y in points if x is not None and any(inside(x, y, [e for e in edges if e[0] == k]) for k in (1, 2, 3))}
    assert found == wanted


def test_convex_polygons_inside_others_are_left_out(frame):
    hexagon = [(30 * math.cos(k * math.pi / 3), 30 * math.sin(k * math.pi / 3)) for k in range(6)]
    edges = (ring(1, *hexagon) + ring(2, (-5, -5), (5, -5), (0, 9)) + ring(3, (0, 9), (5, -5), (-5, -5)) + ring(4, *hexagon) + ring(5, (20, 20), (29, 0), (60, 40))
             + ring(6, (-6, -6), (6, -6), (6, 6), (0, 0), (-6, 6)) + ring(7, (0, 0), (2, 0), (0, 2)) + ring(7, (8, 8), (9, 8), (8, 9)) + ring(8, (200, 0), (201, 0), (200, 3)))
    edges += [(None, 1.0, 1.0, 2.0, 2.0)]
    found = spatial.outer_polygons(frame(edges, EDGES)).collect()
    assert sorted(map(tuple, found), key=str) == sorted((e for e in edges if e[0] not in (2, 3, 4)), key=str)


def test_routes_meet_a_pile_of_polygons_as_one(frame, monkeypatch):
    met, search = [], cuts.polygon_overlaps
    monkeypatch.setattr(cuts, "polygon_overlaps", lambda segments, edges, *rest: met.append(edges.count()) or search(segments, edges, *rest))
    edges = [e for k in range(1, 101) for e in ring(k, (0, 0), (3 * k / 10, k / 10), (k / 10, 2 * k / 10))]
    line = [(-5, 5), (40, 6), (20, -9)]
    row = cuts.route_polygon_profile(route(frame, *line), frame(edges, EDGES)).first()
    assert met == [3] and (row["overlap_m"], row["longest_gap_m"]) == pytest.approx(plain_length(line, edges, 0.0), abs=1e-6)
