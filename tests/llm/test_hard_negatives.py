import math
import random

import pytest

from ledgersieve.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, x string, key string, Label string"


def plain(rows):
    kept = [(i, [math.floor(256 * c) for c in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label)
            for i, v, label in rows
            if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (anchor, va, la) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v)), last(i), i, label)
                         for b, (i, v, label) in enumerate(kept) if b != a), key=lambda s: s[:2])
        for p, _, positive, label in [s for s in scored if s[3] == la][:5]:
            near = [s for s in scored if s[3] != la and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(anchor, positive, r, s[2], -p, -s[0]) for r, s in enumerate(near, 1)]
    return sorted(out, key=str)


def rows_of(seed, n, width, few=False):
    rnd = random.Random(seed)
    part = (lambda: rnd.choice([-1, 0, 1])) if few else (lambda: rnd.gauss(0, 1))  # few: many ties
    return [(i, [float(part()) for _ in range(width)], rnd.randint(0, 3)) for i in range(n)]


ODD = [(0, [1.0, 2.0], 1), (100, [0.0, 0.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [1.0, math.nan], 1),
       (4, [math.inf, 1.0], 2), (5, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (None, [1.0, 1.8], 2),
       (6, [], 2), (8, [1.0], 2), (9, [1.0, 1.9, 5.0], 2), (9, [1.0, 1.9, 5.0], 2), (10, [1.0, 1.7], 3),
       (200, [-1.0, -2.0], 1), (200, [-1.0, -2.0], 1), (11, [-1.0, -1.9], 4), (21, [1.0, 1.95], 0),
       (300, [], 2)]


@pytest.mark.parametrize("rows", [
    ODD, [], rows_of(1, 420, 16), rows_of(2, 420, 6, few=True),
    [(i, v, 0 if i % 3 else label) for i, v, label in rows_of(3, 310, 8)]])
def test_negatives_are_those_of_every_row(spark, monkeypatch, rows):
    monkeypatch.setattr(hn, "ROWS_PER_CELL", 97)
    monkeypatch.setattr(hn, "ANCHORS_PER_CELL", 2)
    monkeypatch.setattr(hn, "FIRST_DEPTH", 2)
    found = hn.hard_negatives(spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows)


def test_access_stops_before_the_end_where_a_few_components_decide():
    import numpy as np
    rnd = np.random.default_rng(0)
    vectors = rnd.integers(-5, 6, (4000, 4))
    lists = hn.Lists(vectors, np.arange(4000), np.zeros(4000), np.arange(4000))
    anchor, seen = np.array([100, 1, -1, 0]), 0
    for rows, scores, bound in lists.access(anchor):
        seen += len(rows)
        assert (scores == vectors[rows] @ anchor).all()
        rest = np.setdiff1d(np.arange(4000), rows)
        if bound is not None and seen < 1000:
            break
    assert bound is not None and seen < 4000 and len(rest)


def test_scores_beyond_64_bits_are_an_error():
    import numpy as np
    lists = hn.Lists(np.array([[2**40]]), np.array([1]), np.array([1]), np.array([1]))
    with pytest.raises(ValueError):
        lists.scores(np.array([0]), np.array([2**40]))
    assert lists.scores(np.array([0]), np.array([2**20]))[0] == 2**60
