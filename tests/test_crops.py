"""Stacked pieces against a plain second computation."""

import random
from itertools import groupby

from examlake.operators import crops as C

PIECE = "paper_id long, seq int, file string, page int, y0 double, y1 double"


def plain(rows):
    out = []
    for (paper, file), group in groupby(sorted(rows, key=lambda r: (r[0], r[2], r[3], r[4], r[5])), key=lambda r: (r[0], r[2])):
        joined = []
        for _, seq, _, page, y0, y1 in group:
            if joined and joined[-1][1] == page and y0 <= joined[-1][3]:
                joined[-1][0], joined[-1][3] = min(joined[-1][0], seq), max(joined[-1][3], y1)
            else:
                joined.append([seq, page, y0, y1])
        at = 0.0
        for n, (seq, page, y0, y1) in enumerate(joined, 1):
            out.append((paper, seq, file, n, page, y0, y1, at))
            at += y1 - y0
    return sorted(out)


def test_stacks(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), 1, f"f{rng.randrange(4)}", rng.randrange(1, 4), float(y := rng.randrange(60)), float(y + rng.randrange(1, 15))) for _ in range(150)]
    rows += rows[:10]
    assert sorted(map(tuple, C.stacked(spark.createDataFrame(rows, PIECE)).collect())) == plain(rows)
    assert C.stacked(spark.createDataFrame([], PIECE)).count() == 0


def test_pieces_over_pages_and_by_hand(spark):
    plan = spark.createDataFrame([(1, 1, "a", 1, 700.0, 3, 50.0), (1, 2, "b", 3, 60.0, 3, 60.0), (1, 3, "c", 3, 60.0, 3, 90.0)], "paper_id long, seq int, file string, page int, y0 double, to_page int, y1 double")
    pages = spark.createDataFrame([(1, 1, 1000.0), (1, 2, None)], "paper_id long, page int, height double")
    pieces = C.crop_pieces(plan, pages)
    assert sorted((r.file, r.page, r.y0, r.y1) for r in pieces.collect()) == [("a", 1, 700.0, 930.0), ("a", 2, 0.0, 744.0), ("a", 3, 0.0, 50.0), ("c", 3, 60.0, 90.0)]
    hand = spark.createDataFrame([(1, 3, "c", 2, 10.0, 20.0), (1, 3, "c", 2, 5.0, 5.0)], PIECE)
    got = [tuple(r) for r in C.stacked(C.recropped(pieces, hand)).orderBy("file", "piece").collect()]
    assert got == [(1, 1, "a", 1, 1, 700.0, 930.0, 0.0), (1, 1, "a", 2, 2, 0.0, 744.0, 230.0), (1, 1, "a", 3, 3, 0.0, 50.0, 974.0), (1, 3, "c", 1, 2, 10.0, 20.0, 0.0)]
