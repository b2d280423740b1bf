"""Token counts alone: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece in a word; dynamic programming over word places then
carries the best score and the number of pieces on the best path, nothing else. Ties follow the reference
tokenizer: of equal scores into one place the earliest start, that is the longest last piece, stands. A
character that is no piece costs ``UNKNOWN`` below the worst score and counts its bytes. Words begin at
spaces (a space belongs to the word after it); each distinct word is solved once per worker.

The default vocabulary, ``piece_bpe_32k.model``, is that of a BPE tokenizer: its scores are merge ranks, not log
probabilities. The counts are exact for the unigram reading of these pieces and scores, and are NOT those of the
BPE tokenizer that the file belongs to: on sf0.01 they differ on 995 of 1,000 texts, 1,091,648 pieces against
957,624. No unigram model is fitted here; one has to be given by ``path`` for counts of a unigram tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from tidemeter.llm.common import BYTE_CODES, U64, chunks, flat, keyed, rolling
from tidemeter.llm.tokenizing import worker_state

UNKNOWN = 10.0
MARK = "▁"
#: Words that a worker remembers, and the length from which a word is solved by itself.
REMEMBERED, LONG = 3_000_000, 64
#: Separates words in the automaton's input; stands in no piece.
_GAP = "\x00"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.tree = ahocorasick.Automaton()
        self.scores = np.array([s for _, s in pieces])
        self.sizes = np.array([len(p) for p, _ in pieces])
        for i, (p, _) in enumerate(pieces):
            if p and _GAP not in p:
                self.tree.add_word(p, i)  # a repeated piece counts as its last entry
        self.tree.make_automaton()
        self.unknown = self.scores.min() - UNKNOWN
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts, self.best = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0)

    def solve(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of the best path of each string, each with its mark before it."""
        text = _GAP + _GAP.join(strings) + _GAP
        found = np.array(list(self.tree.iter(text)), np.int64).reshape(-1, 2)
        end, piece = found[:, 0] + 1, found[:, 1]
        size, score = self.sizes[piece], self.scores[piece]
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        single = np.zeros(len(chars) + 1, bool)
        single[end[size == 1]] = True
        gap = chars == 0
        lone = np.flatnonzero(~gap & ~single[1:]) + 1
        bytes_ = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4)))
        # Candidates into a place by start, earliest first; an unknown character starts last.
        end = np.concatenate((end, lone))
        size = np.concatenate((size, np.ones(len(lone), np.int64)))
        score = np.concatenate((score, np.full(len(lone), self.unknown)))
        pieces = np.concatenate((np.ones(len(piece), np.int64), bytes_[lone - 1]))
        begin = np.flatnonzero(gap)[:-1] + 1
        word = np.searchsorted(begin, end - 1, "right") - 1
        level = end - begin[word]
        order = np.lexsort((-size, end, level))
        end, size, score, pieces, level = (x[order] for x in (end, size, score, pieces, level))
        best, count = np.zeros(len(chars) + 1), np.zeros(len(chars) + 1, np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1]))) if len(level) else np.zeros(0, np.int64)
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(level)], strict=True):
            into, start = end[lo:hi], end[lo:hi] - size[lo:hi]
            value = score[lo:hi] + best[start]
            run = np.flatnonzero(np.concatenate(([True], into[1:] != into[:-1])))
            top = np.maximum.reduceat(value, run)
            place = np.where(value == np.repeat(top, np.diff(np.append(run, len(into)))), np.arange(len(into)), len(into))
            pick = np.minimum.reduceat(place, run)
            best[into[run]], count[into[run]] = top, count[start[pick]] + pieces[lo:hi][pick]
        last = np.flatnonzero(gap)[1:]
        return count[last], best[last]

    def words(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of each word; a word that holds the mark itself is several."""
        parts, owner = [], []
        for i, s in enumerate(strings):
            own = [MARK + x for x in s.split(MARK)]
            parts += own
            owner += [i] * len(own)
        count, best = np.zeros(len(strings), np.int64), np.zeros(len(strings))
        for group in (short := [i for i, p in enumerate(parts) if len(p) <= LONG and _GAP not in p], [i for i, p in enumerate(parts) if len(p) > LONG and _GAP not in p]):
            for lo in range(0, len(group), 20_000 if group is short else 1):
                rows = group[lo: lo + (20_000 if group is short else 1)]
                c, b = self.solve([parts[i] for i in rows])
                np.add.at(count, np.array(owner)[rows], c)
                np.add.at(best, np.array(owner)[rows], b)
        for i, p in enumerate(parts):
            if _GAP in p:  # a NUL is unknown and no piece spans it
                runs = p.split(_GAP)
                c, b = self.solve([r for r in runs if r])
                count[owner[i]] += c.sum() + len(runs) - 1
                best[owner[i]] += b.sum() + self.unknown * (len(runs) - 1)
        return count, best

    def slots(self, hashes: np.ndarray, text) -> tuple[np.ndarray, np.ndarray]:
        found, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(found) > REMEMBERED:
            self.clear()
        place = np.searchsorted(self.keys, found)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != found) if len(self.keys) else np.arange(len(found))
        if len(new):
            count, best = self.words([text(i) for i in where[new].tolist()])
            self.keys = np.insert(self.keys, place[new], found[new])
            self.counts = np.insert(self.counts, place[new], count)
            self.best = np.insert(self.best, place[new], best)
            place = np.searchsorted(self.keys, found)
        return self.counts[place][back], self.best[place][back]


def _spaced(texts: pa.Array):
    """Words between single spaces, empty ones too: bytes, starts, ends, words before each text."""
    data, at = flat(texts)
    n = np.diff(at)
    cut = np.flatnonzero(data == 0x20)
    # A space opens the word after it; a text that begins with neither space nor mark opens one there.
    lead = at[:-1][n > 0]
    marked = np.zeros(len(lead), bool)
    three = lead + 3 <= len(data)
    lead3 = lead[three]
    marked[three] = (data[lead3] == 0xE2) & (data[lead3 + 1] == 0x96) & (data[lead3 + 2] == 0x81)
    opens = lead[data[lead] != 0x20]
    skip = np.where(marked[data[lead] != 0x20], 3, 0)  # its own mark serves
    starts = np.concatenate((cut + 1, opens + skip))
    begin = np.concatenate((cut, opens))
    order = np.argsort(begin, kind="stable")
    starts, begin = starts[order], begin[order]
    limit = at[np.searchsorted(at, begin, "right")]
    ends = np.minimum(np.append(begin[1:], len(data)), limit)
    return data, starts, ends, np.searchsorted(begin, at)


def _count(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state("counter", name, lambda: Counter(shared.value))
        for batch in chunks(batches):
            data, starts, ends, first = _spaced(batch.column("text"))
            count, best = counter.slots(rolling(BYTE_CODES[data], starts, ends), lambda i: data[starts[i]: ends[i]].tobytes().decode())
            total = np.concatenate(([0], np.cumsum(count)))
            some = np.flatnonzero(np.diff(first))
            score = np.zeros(batch.num_rows)
            if len(some):
                score[some] = np.add.reduceat(best, first[some])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(total[first[1:]] - total[first[:-1]]), pa.array(np.diff(first).astype(np.int64)), pa.array(score)],
                names=["doc_id", "key", "n_pieces", "n_words", "score"])
    return run


def count_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, key, n_pieces, n_words, score`` for each row.

    Null and empty texts have none. Repeated rows are counted each. Other columns are not read. Without ``path``
    the pieces and merge ranks of a BPE model are read as a unigram vocabulary (see above).
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    return keyed(docs).mapInArrow(_count(shared, f"counter {path}"), "doc_id long, key long, n_pieces long, n_words long, score double")


def report(docs: DataFrame) -> DataFrame:
    return count_pieces(docs).select("doc_id", "n_pieces", "n_words", "score")
