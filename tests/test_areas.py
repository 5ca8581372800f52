import random

from lumenloom.operators import areas


def _pixels(image, lines):
    return [(image, x, y) for y, line in enumerate(lines) for x, c in enumerate(line) if c == "#"]


def _brute(pixels):
    """image -> (ink, box, holes) by a flood from the edge of the box."""
    out = {}
    for image in {p[0] for p in pixels}:
        ink = {(x, y) for i, x, y in pixels if i == image}
        xs, ys = [x for x, _ in ink], [y for _, y in ink]
        box = {(x, y) for x in range(min(xs), max(xs) + 1) for y in range(min(ys), max(ys) + 1)}
        free = box - ink
        todo = [(x, y) for x, y in free if x in (min(xs), max(xs)) or y in (min(ys), max(ys))]
        water = set(todo)
        while todo:
            x, y = todo.pop()
            for near in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if near in free and near not in water:
                    water.add(near)
                    todo.append(near)
        out[image] = (len(ink), len(box), len(free - water))
    return out


def _found(spark, pixels):
    rows = areas.enclosed(spark.createDataFrame(pixels, "image_id int, x int, y int")).collect()
    return {r["image_id"]: (r["ink_n"], r["box_n"], r["hole_n"]) for r in rows}


def _spiral(n):
    """A wall that winds inwards, so that the way in passes every line many times; open at its end, or shut."""
    grid, x, y, dx, dy, steps = [["." for _ in range(n)] for _ in range(n)], 0, 0, 1, 0, n
    while steps > 1:
        for _ in range(2 if steps < n else 3):
            for _ in range(steps - 1):
                grid[y][x] = "#"
                x, y = x + dx, y + dy
            dx, dy = -dy, dx
        steps -= 2
    return ["".join(line) for line in grid]


def test_shapes(spark):
    pictures = [
        ["#####", "#...#", "#.#.#", "#...#", "#####"],
        [".###.", "#...#", ".###."],
        ["####", "#..#", "#.##", "####", "....", "#..."],
        ["#"],
        ["###", "#.#", "##."],
        ["#.#", ".#.", "#.#"],
        _spiral(41),
        ["#" * 43, *["#" + line + "#" for line in _spiral(41)], "#" * 43],
    ]
    pixels = [p for i, lines in enumerate(pictures) for p in _pixels(i, lines)]
    want = _brute(pixels)
    assert want[0][2] == 8 and want[1][2] == 3 and want[6][2] == 0 and want[7][2] > 0
    assert _found(spark, pixels + pixels[:9] + [(0, None, 2), (9, 1, None)]) == want


def test_random_pictures_and_none(spark):
    rng = random.Random(5)
    pixels = [(i, x + i, y) for i in range(12) for x in range(5 + 3 * i) for y in range(30 - 2 * i) if rng.random() < 0.3 + 0.05 * i]
    assert _found(spark, pixels) == _brute(pixels)
    assert _found(spark, []) == {}


def test_runs_at_the_edge_are_one_node(spark):
    """Their links with one another can't change what is enclosed, but took their share of every round."""
    rows = [(1, y, x, x + 1, x in (0, 8) or y in (0, 5)) for y in range(6) for x in (0, 4, 8)]
    links = areas._links(spark.createDataFrame(rows, "image_id int, y long, start long, end long, edge boolean")).collect()
    at = lambda y: y * areas.WIDEST + 4
    assert sorted(sorted((r.a, r.b)) for r in links) == sorted([[areas.EDGE, at(1)], [at(1), at(2)], [at(2), at(3)], [at(3), at(4)], [areas.EDGE, at(4)]])
