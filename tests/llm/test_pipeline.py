"""The pipeline against its stages in plain Python, and every registered SQL twin on the smallest tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.compare import connect, difference
from tests.llm import brute
from tests.llm.test_private import sentences
from tests.llm.test_text import prose
from tidemeter.llm import jaccard, queries

ROOT = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    data = sentences(700, 5)
    passage = prose(rng, 60, 5000)
    item = prose(rng, 30, 5000)
    base = prose(rng, 150, 5000).split(" ")
    docs = [(i, t) for i, t, _ in data]
    docs += [(1000 + i, prose(rng, 40, 5000) + "\n" + passage + "\n" + prose(rng, 40, 5000)) for i in range(8)]
    docs += [(1100 + i, " ".join([*base[:70], f"edit{i}", *base[71:]])) for i in range(12)]
    docs += [(1200 + i, prose(rng, 20, 5000) + " " + item + " " + prose(rng, 20, 5000)) for i in range(5)]
    docs += [(1300, None), (1301, ""), (1302, docs[-1][1]), (1303, prose(rng, 3000, 5000)), (None, prose(rng, 50, 5000)), (1304, "calm words only")]
    labels = [(i, 1, y) for i, _, y in data]
    spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, "extra") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, key string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    toxic = {i for i, _, y in data if y}
    raw = spark.read.parquet(f"{tmp_path}/documents.parquet")
    passed = {r[0] for r in corpus_pipeline.drop_toxic(spark, raw, str(tmp_path)).select("doc_id").collect()}
    wrong = len(passed & toxic) + len({i for i, _, y in data if not y} - passed)
    assert wrong <= 0.03 * len(data) and {i for i, _ in docs[700:]} <= passed
    # What line dedup emptied goes with it; texts that were empty before stay.
    left = [(i, t) for i, t, gone in brute.lines([d for d in docs if d[0] in passed]) if not gone or brute.SPACED.findall(t)]
    named = brute.jaccard(left)
    left = [d for d, (i, n, c) in zip(left, named) if i == c]
    bad = {r[0] for r in brute.decontaminate(left, [(7, item)]) if r[-1]}
    left = [d for d in left if d[0] not in bad]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc, text in left:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(doc, lo // 2048, lo, len(ids[lo: lo + 2048]), zlib.crc32(np.array(ids[lo: lo + 2048], "<u4").tobytes())) for lo in range(0, len(ids), 2048)]

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near copies", "decontamination", "packing"]
    made = corpus_pipeline.run(spark, str(tmp_path))
    got = [tuple(r)[:5] for r in made.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = {r[0] for r in got}
    assert not kept & (toxic - passed)
    assert not kept & {1200, 1201, 1302}, "contaminated"
    assert len(kept & set(range(1100, 1112))) == 1, "near copies"


def test_near_copies_between_the_limits(spark):
    rng = random.Random(33)
    words = [f"w{i}" for i in range(230)]
    edited = [f"edit{i}" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(words)]
    docs = [(1, " ".join(words)), (2, " ".join(edited)), (3, prose(rng, 230, 5000))]
    five, four = ([brute.shingles(t, n) for _, t in docs[:2]] for n in (5, 4))
    assert len(five[0] & five[1]) / len(five[0] | five[1]) >= 0.8 and len(four[0] & four[1]) / len(four[0] | four[1]) < 0.85
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, ROOT).collect()) == [1, 3]
    assert sorted(r.doc_id for r in jaccard.distinct(df).collect()) == [1, 2, 3]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").limit(5)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, ROOT).columns == docs.columns


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twin(spark, name):
    assert difference(queries.queries()[name](spark, ROOT), connect(ROOT), queries.oracle_sql()[name]) is None


def test_all_are_registered():
    names = set(queries.queries()) | set(corpus_pipeline.queries())
    assert {n.split("_")[0] for n in names} == {"pipeline", *(f"op{i}" for i in range(1, 14))}
