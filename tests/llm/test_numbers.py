"""Search, packing and token counts against brute force."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm.test_text import frame, prose, rows
from tidemeter.llm import packing, tokencounts, tokenizing, topk


def test_top_k(spark):
    rng = random.Random(3)
    data = [(i, [rng.uniform(-1, 1) for _ in range(40)]) for i in range(230)]
    data += [(1000 + i, data[7][1]) for i in range(40)]  # ties
    data += [(2000, None), (2020, [1.0, None] * 20), (2040, [float("nan")] * 40), (2060, [math.inf] * 40), (2080, [0.5] * 3), (2100, []), (20, data[9][1]), (None, data[20][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumnsRenamed({}).selectExpr("*", "'x' as block", "1 as rank").repartition(4)
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (qid, q) in enumerate(good):
        if qid is None or qid % 20:
            continue
        found = sorted(((-sum(x * y for x, y in zip(q, v)), -math.inf if i is None else i, i) for b, (i, v) in enumerate(good) if b != a and len(v) == len(q)))[:20]
        want += [(qid, r, i, -s) for r, (s, _, i) in enumerate(found, 1)]
    assert rows(topk.top_k(df)) == sorted(want, key=str)
    assert topk.top_k(df.where("false")).count() == 0


def test_top_k_beyond_doubles(spark):
    data = [(i, [1e12 * (i + 1) + j for j in range(5)]) for i in range(25)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    ints = {i: [math.floor(64 * x) for x in v] for i, v in data}
    dot = lambda a, b: min((1 << 63) - 1, sum(x * y for x, y in zip(ints[a], ints[b])))
    want = [(q, r, i, s) for q in (0, 20) for r, (s, i) in enumerate(sorted(((dot(q, i), i) for i in ints if i != q), key=lambda x: (-x[0], x[1]))[:20], 1)]
    assert rows(topk.top_k(df)) == sorted(want, key=str)


def test_top_k_of_the_largest_doubles(spark):
    data = [(i, [(-1.0) ** i * 1e308, 1.0]) for i in range(22)]
    got = rows(topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>")))
    want = [(q, r, i, (1 << 63) - 1 if r <= 10 else -(1 << 63)) for q in (0, 20) for r, i in enumerate([*(j for j in range(0, 22, 2) if j != q), *range(1, 21, 2)][:20], 1)]
    assert got == sorted(want, key=str)


def test_top_k_of_many_large_dimensions(spark):
    """2,048 components near 2**22: sums that doubles would round."""
    rng = random.Random(12)
    data = [(i, [rng.randrange(1 << 21, 1 << 22) / 64 for _ in range(2048)]) for i in range(24)]
    ints = [[round(64 * x) for x in v] for _, v in data]
    want = []
    for q in (0, 20):
        found = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in enumerate(ints) if i != q)[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    assert rows(topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"))) == sorted(want, key=str)


def test_plan_uses_all_and_is_tight():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice((10, 64, 2048))
        counts = {s: rng.randrange(1, 40) for s in rng.sample(range(1, capacity + 1), min(capacity, rng.randrange(1, 30)))}
        used = {}
        for many, pattern in (lines := packing.plan(dict(counts), capacity)):
            assert sum(s * c for s, c in pattern.items()) <= capacity
            for s, c in pattern.items():
                used[s] = used.get(s, 0) + many * c
        assert used == counts
        rooms = []
        for s in sorted((s for s, c in counts.items() for _ in range(c)), reverse=True):  # plain best fit decreasing
            fitting = [r for r in rooms if r >= s]
            if fitting:
                rooms.remove(min(fitting))
            rooms.append((min(fitting) if fitting else capacity) - s)
        assert sum(m for m, _ in lines) <= len(rooms) + 1


def test_dominance_keeps_the_optimum():
    # 7 + 3 and 6 + 4 fill; best fit decreasing alone does as well, a greedy 7 + 2 would not.
    assert sum(m for m, _ in packing.plan({7: 2, 6: 2, 4: 2, 3: 2}, 10)) == 4
    assert packing.dominating(packing._Sizes({9: 1, 8: 1}), 9, 10) == [9]
    assert packing.dominating(packing._Sizes({6: 1, 4: 1, 1: 9}), 6, 10) == [6, 4]


def test_units_give_the_ids_of_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, rng = Tokenizer.from_file(path), random.Random(1)
    texts = ["".join(rng.choice("abAB'.,<|> \t\n\x1c\x850é́—ñΣs½³İ") for _ in range(rng.randrange(25))) for _ in range(1500)]
    texts += ["", " ", "<|endoftext|>", " <|endoftext|>b <|ENDOFTEXT|>", "don't I'LL 's's .'s", "a" * 3000]
    ids, at = tokenizing.encode(pa.array(texts), path)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(spark):
    rng = random.Random(5)
    docs = [(i, prose(rng, rng.choice((0, 1, 30, 400, 900, 2500)))) for i in range(60)] + [(70, None), (71, ""), (None, "a b"), (5, "other text"), (72, "a b"), (72, "a b")]
    made = packing.report(frame(spark, docs)).toPandas()
    whole, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for doc, text in docs:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(doc, lo // 2048, lo, len(ids[lo: lo + 2048]), zlib.crc32(np.array(ids[lo: lo + 2048], "<u4").tobytes())) for lo in range(0, len(ids), 2048)]
    got = [(None if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in made[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got, key=str) == sorted(want, key=str)
    for _, s in made.sort_values("offset").groupby("sequence_id"):
        ends = (s.offset + s.length).tolist()
        assert [0, *ends[:-1]] == s.offset.tolist() and ends[-1] <= 2048
    assert made.sequence_id.nunique() <= -(-made.length.sum() // 2048) + 1
    assert packing.report(frame(spark, [])).count() == 0


def test_token_counts(spark):
    pieces = tokencounts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(9)
    docs = [(i, "".join(rng.choice("abtheng ▁ éñ\n\t<0x>s</€𝄞 \x00") for _ in range(rng.randrange(40)))) for i in range(800)]
    docs += [(900, None), (901, ""), (902, " "), (903, "▁a"), (904, "long" * 2000), (905, "<s> <0x41>"), (None, "null id"), (905, "<s> <0x41>")]
    got = rows(tokencounts.report(frame(spark, docs)), "doc_id", "n_pieces")
    assert got == sorted(((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in docs), key=str)
    assert tokencounts.report(frame(spark, [])).count() == 0


def test_ties_go_to_the_longest_last_piece():
    counter = tokencounts.Counter([("<unk>", 0.0), ("▁a", -1.0), ("b", -1.0), ("▁ab", -3.0), ("c", -1.0), ("bc", -2.0)])
    # "▁a" + "bc" and "▁a" + "b" + "c" score alike: the earliest start into the end wins.
    assert counter.words(["abc"])[0].tolist() == [2]


def test_counts_of_the_bpe_model_are_stated_to_differ():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    text = "The people have international cooperation"
    count, _ = tokencounts.Counter(tokencounts.vocabulary(path)).words(text.split(" "))
    assert (count.sum(), len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))) == (15, 5)
    assert "BPE" in tokencounts.__doc__ and "BPE" in tokencounts.count_pieces.__doc__
