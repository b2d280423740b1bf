"""Periodic runs against plain enumeration."""

import random
import zlib

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.test_text import rows
from tidemeter.llm import periodicity


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(6, 4 * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain(docs):
    out = []
    for doc, text in docs:
        w = brute.SPACED.findall(text or "")
        n = len(w)
        h = zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        out.append((doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                    brute.sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def test_cover_reaches_every_distance():
    gaps = {(a - b) % periodicity.MODULUS for a in periodicity.COVER for b in periodicity.COVER}
    assert gaps == set(range(periodicity.MODULUS))


@pytest.mark.parametrize("seed", range(6))
def test_runs_match_enumeration(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(periodicity, "PAIRS", rng.choice((7, 1000, 1 << 20)))
    for _ in range(30):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            n, k = rng.choice((0, 1, 5, 6, 7, 20, 60, 300, 900)), rng.choice((1, 2, 3, 50))
            w = [rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randrange(3) if n > 10 else 0):
                a = rng.randrange(n)
                per = rng.randrange(1, max(2, (n - a) // rng.randrange(3, 9) + 1))
                for i in range(a, rng.randrange(a, n) + 1):
                    w[i] = w[a + (i - a) % per]
            docs.append(w)
        first = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        got = [[] for _ in docs]
        for d, *run in zip(*(x.tolist() for x in periodicity.runs(np.array([x for d in docs for x in d], np.int64), first)), strict=True):
            got[d].append(tuple(run))
        assert got == [plain_runs(d) for d in docs]


def test_extensions_match_comparison():
    rng = random.Random(3)
    w = [rng.randrange(2) for _ in range(200)] * 3 + [-1]
    table = periodicity.Extensions(np.array(w))
    at = table.samples
    i, j = (np.array([rng.choice(at.tolist()) for _ in range(500)]) for _ in range(2))
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i.tolist(), j.tolist(), table.synchronised(i, j).tolist(), strict=True):
        assert w[a: a + n] == w[b: b + n] and (max(a, b) + n == len(w) or w[a + n] != w[b + n])


def test_report_matches_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n, k: " ".join(f"w{rng.randrange(k)}é" for _ in range(n))
    docs = [(i, text(rng.choice((0, 1, 3, 40, 250)), rng.choice((1, 2, 900)))) for i in range(160)]
    docs += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (None, "a a a a a a"), (None, None)]
    docs += [(204, "x " * 6), (205, "x " * 5), (206, "a b " * 4), (207, "a b a b a b a"), (208, "A a " * 9 + "   ")]
    docs += [(209, text(30, 900) + "\n" + "p q r\t" * 700 + text(3000, 2)), docs[5], docs[5]]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as runs", "2 as best", "'y' as collapsed").repartition(5)
    assert rows(periodicity.report(df)) == plain(docs)
    assert periodicity.report(df.where("false")).count() == 0
    monkeypatch.setattr(periodicity, "JOINED", 11)
    assert rows(periodicity.report(df)) == plain(docs)


def test_find_gives_runs_and_text(spark):
    df = spark.createDataFrame([(1, "so  be it it it it it it\tthen")], "doc_id long, text string")
    (row,) = periodicity.find(df).collect()
    assert row.n_words == 9 and [tuple(r) for r in row.runs] == [(2, 6, 1)] and row.collapsed == "so be it then"
