"""What the driver holds while the toxicity machine learns."""

import inspect

import numpy as np
import pyarrow as pa

from tidemeter.llm import toxicity


def test_the_driver_holds_each_word_once():
    words = ["dull", "word", "dull", "é", "a"] * 2000
    rows = pa.table({"doc_id": [3, 1, 2], "toxic": pa.array([0, 1, 0], pa.int32()), "bag": pa.array([words, ["a", "zz"], []], pa.list_(pa.string()))})
    every, toxic, clean = toxicity._numbered(rows)
    assert every == ["a", "dull", "word", "zz", "é"]
    assert [b.tolist() for b in toxic] == [[0, 3]] and clean[0].tolist() == [] and clean[1][:5].tolist() == [1, 2, 1, 4, 0]
    # 4 bytes an occurrence; lists of strings took some 60.
    assert sum(b.nbytes for b in clean) == 4 * len(words)


def test_no_documents_and_one_class():
    none = pa.table({"doc_id": pa.array([], pa.int64()), "toxic": pa.array([], pa.int32()), "bag": pa.array([], pa.list_(pa.string()))})
    assert toxicity._numbered(none) == ([], [], [])
    for toxic, clean, side in (([], [np.array([0])], -3.0), ([np.array([0])], [], 3.0), ([], [], -3.0)):
        assert toxicity.fit(["a"], toxic, clean).final[-1] == side


def test_words_reach_the_driver_as_arrow():
    assert "collect()" not in inspect.getsource(toxicity.train).split("bags =")[1]
