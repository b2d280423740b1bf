"""Vector codes against whole-number brute force."""

import hashlib
import math
import random

import numpy as np

from tests.llm.test_text import rows
from tidemeter.llm import vectorcodes


def plain(data, parts=4, entries=256, rounds=4):
    """``data``: (id, vector, label); all lengths equal and divisible by ``parts``."""
    good = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = len(good[0][1]) // parts
    cut = lambda v, p: v[p * wide: (p + 1) * wide]
    books = [[cut(v, p) for _, v, _ in good[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min((gap(cut(v, p), b), e) for e, b in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(p, v)[1] for p in range(parts)] for _, v, _ in good]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), f in zip(good, found, strict=True) if f[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out, sums = [], {}
    for i, v, y in good:
        hits = [near(p, v) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in hits), sum(d for d, _ in hits), y))
        sums[y] = sums.get(y, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for v in b for x in v).encode()).hexdigest()
    return sorted([(i, c, d, sums[y], sha) for i, c, d, y in out], key=str), books


def test_codes_match_brute_force(spark):
    rng = random.Random(11)
    centres = [[rng.gauss(0, 0.3) for _ in range(16)] for _ in range(40)]
    data = [(1000 - i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.choice((1, 2, None))) for i in range(420)]
    data += [(2000 + i, data[5][1], 1) for i in range(30)]  # ties and repeated vectors
    data += [data[9], data[9], (None, data[3][1], None)]
    data += [(3000, None, 1), (3001, [0.1] * 15 + [None], 1), (3002, [float("nan")] * 16, 1), (3003, [-math.inf] * 16, 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as code", "1 as part", "2 as error").repartition(3)
    want, books = plain(data)
    assert rows(vectorcodes.report(df)) == want
    assert [b.tolist() for b in vectorcodes.learn(df)] == books


def test_few_vectors_and_small_codebooks(spark):
    data = [(i, [i / 8, -i / 8, 0.5, float(i % 3)], i % 2) for i in range(9)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    assert rows(vectorcodes.report(df)) == plain(data)[0]
    books = vectorcodes.learn(df, entries=2, rounds=3)
    want, plain_books = plain(data, entries=2, rounds=3)
    assert [b.tolist() for b in books] == plain_books
    assert sorted((r.vec_id, r.code, r.error) for r in vectorcodes.encode(df, books).collect()) == sorted(w[:3] for w in want)


def test_empty_odd_and_huge(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert vectorcodes.report(spark.createDataFrame([], schema)).count() == 0
    assert vectorcodes.report(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    assert [r.error for r in vectorcodes.report(spark.createDataFrame([(1, [], 1), (2, [], None)], schema)).collect()] == [0, 0]
    # Lengths differ: filled up with zeros. No label column: all labels are one.
    short = spark.createDataFrame([(1, [0.5, 0.5, 0.5]), (2, [0.5, 0.5, 0.5, 0.0]), (3, [1.0] * 5)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vectorcodes.report(short).collect()}
    assert got[1].code == got[2].code != got[3].code and got[3].error == 0
    huge = spark.createDataFrame([(i, [(-1.0) ** i * 1e308] * 8, 1) for i in range(300)], schema)
    assert {r.error for r in vectorcodes.report(huge).collect()} == {0}


def test_decode_is_near(spark):
    rng = random.Random(4)
    data = [(i, [rng.uniform(-1, 1) for _ in range(8)], 0) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    books = vectorcodes.learn(df)
    for r in vectorcodes.decode(vectorcodes.encode(df, books), books).collect():
        assert sum((a - b) ** 2 for a, b in zip(r.embedding, data[r.vec_id][1], strict=True)) <= r.error / 1024 ** 2 + 0.02


def test_search_keeps_the_nearest_of_any_codebook():
    rng = np.random.default_rng(5)
    for k, d in ((1, 3), (2, 1), (63, 2), (64, 5), (200, 16), (300, 7)):
        book = rng.integers(-40, 40, (k, d))
        x = rng.integers(-60, 60, (500, d))
        code, least, _ = vectorcodes.Slices(book).nearest(x)
        gaps = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (code == gaps.argmin(1)).all() and (least == gaps.min(1)).all()
    tight = np.repeat(rng.integers(-10 ** 5, 10 ** 5, (100, 8)), 2, 0)  # clusters far apart: few candidates are left
    x = tight[rng.integers(0, 200, 400)] + rng.integers(-5, 5, (400, 8))
    code, _, taken = vectorcodes.Slices(tight).nearest(x)
    assert (code % 2 == 0).all() and taken < 40 * len(x)
