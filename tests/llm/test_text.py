"""Operators over texts against brute force: nulls, empties, ties, repeated rows, clashing columns, no rows."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemeter.llm import decontaminate, jaccard, linedup, substrings, suffixes

CLASH = ("key", "n", "pos", "score", "row", "kinds", "n_lines", "cuts", "d", "hash", "prefix", "gone")


def frame(spark, rows, ident="doc_id"):
    """With columns named like those that operators use inside."""
    df = spark.createDataFrame(rows, f"{ident} long, text string")
    return df.withColumns({c: F.lit(None).cast("string") if c == "row" else F.lit(c) for c in CLASH}).repartition(3)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str) if columns else sorted((tuple(r) for r in df.collect()), key=str)


def prose(rng, n, vocabulary=40):
    return " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) + str(rng.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    shared = [prose(rng, n) for n in (6, 12, 19, 20, 21, 45, 90, 160)]
    docs = []
    for i in range(70):
        parts = [prose(rng, rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(shared), prose(rng, rng.randrange(0, 12))]
        docs.append((i, rng.choice((" ", "\n", " \t")).join(parts)))
    base = prose(rng, 120, 4000).split(" ")
    for i in range(100, 130):  # near copies
        w = base.copy()
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"edit{i}{rng.randrange(9)}"
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "   \n "), (203, "one"), (204, "ONE"), (205, "la " * 300), (206, docs[3][1]), (206, docs[3][1]),
             (207, "Ünï cødé—ñ. " * 30), (None, docs[5][1]), (208, prose(rng, 9000, 7)), (209, "a b c"), (210, "A  b\tc")]
    return docs, shared


def test_decontaminate(spark, texts):
    docs, shared = texts
    items = [*enumerate(shared), (50, shared[3]), (51, "One"), (52, None), (53, ""), (54, " . , "), (None, shared[5]), (3, shared[3]), (60, "b c a")]
    got = {tuple(r) for r in decontaminate.report(frame(spark, docs), frame(spark, items, "item_id")).collect()}
    assert got == brute.decontaminate(docs, items)
    left = decontaminate.clean(frame(spark, docs), frame(spark, items, "item_id"))
    assert left.columns == ["doc_id", "text", *CLASH]
    bad = {r[0] for r in brute.decontaminate(docs, items) if r[-1]}
    assert rows(left, "doc_id") == sorted(((d,) for d, _ in docs if d not in bad), key=str)


def test_substrings(spark, texts):
    docs, _ = texts
    assert rows(substrings.report(frame(spark, docs))) == sorted(brute.substrings(docs), key=str)


def test_substrings_of_rows_that_share_an_id(spark):
    text = prose(random.Random(2), 60)
    other = text + " end"
    got = rows(substrings.report(frame(spark, [(1, text), (1, other), (1, other)])), "n_words", "n_removed")
    assert sorted(x[1] for x in got)[-1] == 60 and len(got) == 3


@pytest.mark.parametrize("crowd", [4096, 2])
def test_suffixes(spark, texts, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    docs = [d for d in texts[0] if len(d[1] or "") < 6000] + [(301, "x" * 400), (302, "x" * 399), (303, "ab" * 900)]
    docs += [(304 + k, d[1]) for k, d in enumerate(docs[60:66])]
    assert rows(suffixes.report(frame(spark, docs))) == sorted(brute.suffixes(docs), key=str)


def test_deep_shallow_orders_suffixes():
    rng = random.Random(4)
    text = "".join(rng.choice("ab") for _ in range(60)).encode() * 20 + bytes(rng.randrange(256) for _ in range(900))
    import numpy as np

    starts = np.arange(len(text) - suffixes.SPAN)
    groups = list(suffixes.deep_shallow(text, starts))
    found = [text[g[0]: g[0] + suffixes.SPAN] for g in groups]
    assert found == sorted(set(text[i: i + suffixes.SPAN] for i in starts))
    assert sorted(p for g in groups for p in g) == starts.tolist()


def test_jaccard(spark, texts):
    docs, _ = texts
    assert rows(jaccard.report(frame(spark, docs))) == sorted(brute.jaccard(docs), key=str)
    kept = jaccard.distinct(frame(spark, docs))
    least = {c for d, _, c in brute.jaccard(docs) if c is not None}
    assert kept.columns == ["doc_id", "text", *CLASH]
    assert sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None) == sorted(least)


def test_lines(spark, texts):
    docs, shared = texts
    rng = random.Random(8)
    pool = [prose(rng, n) for n in (0, 1, 3, 10, 24, 25, 26, 60)]
    docs = docs[:30] + docs[-13:] + [(400 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(40)] + [(None, pool[-1])]
    made = linedup.dedup(frame(spark, docs))
    assert made.columns == ["doc_id", "text", *(c for c in CLASH if c != "n_lines"), "n_lines", "n_removed", "n_runs"]
    assert rows(made, "doc_id", "text", "n_removed") == sorted(brute.lines(docs), key=str)


def test_short_notices_go_when_asked_for(spark):
    rng = random.Random(12)
    notice = prose(rng, 24, 5000)
    docs = [(i, prose(rng, 30, 5000) + (f"\n{notice}" if i % 3 == 0 else "")) for i in range(12)]
    df = frame(spark, docs)
    for words in (25, 24, 1):
        assert rows(linedup.report(df, words), "doc_id", "n_removed") == sorted(((d, n) for d, _, n in brute.lines(docs, words)), key=str)
    assert sum(r.n_removed for r in linedup.report(df, 1).collect()) == 3


def test_native_operator_runs_no_python(spark, texts):
    plan = linedup.dedup(frame(spark, texts[0][:9]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_no_rows(spark):
    none, item = frame(spark, []), frame(spark, [(1, "a b c")], "item_id")
    full = frame(spark, [(1, "a b c d e f")])
    for made in (
            decontaminate.report(none, item), decontaminate.clean(none, item), substrings.report(none), suffixes.report(none),
            jaccard.report(none), jaccard.distinct(none), linedup.report(none)):
        assert made.count() == 0
    assert rows(decontaminate.report(full, frame(spark, [], "item_id")), "doc_id", "n_words", "n_hit") == [(1, 6, 0)]
