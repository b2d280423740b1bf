"""Token ids of whole texts, each distinct unit of text encoded once per worker process.

The word tokenizer drops white space and never joins what stands on both sides of it, nor an ASCII letter
with an ASCII sign beside it (unless an apostrophe or a special token may be involved); such units are
encoded alone and gathered. Texts themselves are never cut.
"""

from __future__ import annotations

import os
import sys
import types

import numpy as np
import pyarrow as pa

from tidemeter.llm.common import BYTE_CODES, LOWER, SPACES, U64, flat, rolling

#: Units that a worker remembers; beyond that it starts anew.
REMEMBERED = 2_000_000

_B = np.arange(256)
_LETTER = (_B >= 0x61) & (_B <= 0x7A) | (_B >= 0x41) & (_B <= 0x5A)
_SIGN = (_B < 0x80) & ~_LETTER & ~SPACES


def worker_state(kind: str, version: str, make):
    """Kept in the worker process between tasks; functions that travel by value have no other place. A kind has one
    slot: what another version left there goes, so a worker that serves many queries holds no more than one of each."""
    home = sys.modules.setdefault("_worker_state", types.ModuleType("_worker_state")).__dict__
    if kind not in home or home[kind][0] != version:
        home.pop(kind, None)
        home[kind] = (version, make())
    return home[kind][1]


class Units:
    """Hash of a unit -> its ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, U64), np.zeros(0, np.int64)
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32)

    def slots(self, hashes: np.ndarray, text) -> np.ndarray:
        """Slots of all ``hashes``; ``text(i)`` gives the unit of ``hashes[i]``."""
        found, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(found) > REMEMBERED:
            self.clear()
        place = np.searchsorted(self.keys, found)
        known = self.keys[np.minimum(place, len(self.keys) - 1)] == found if len(self.keys) else np.zeros(len(found), bool)
        new = np.flatnonzero(~known)
        if len(new):
            ids = [e.ids for e in self.encode([text(i) for i in where[new].tolist()], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            end = int(self.at[-1]) + int(sizes.sum())
            if end > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros(max(end - len(self.ids), len(self.ids)), np.uint32)))
            self.ids[self.at[-1]: end] = [i for x in ids for i in x]
            fresh = len(self.at) - 1 + np.arange(len(new))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))
            self.slot = np.insert(self.slot, place[new], fresh)
            self.keys = np.insert(self.keys, place[new], found[new])
            place = np.searchsorted(self.keys, found)
        return self.slot[place][back]


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of all units, and ``n + 1`` numbers of units before each text."""
    data, at = flat(texts)
    inside = ~SPACES[data]
    edge = at[(at > 0) & (at < len(data))]
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    before[edge] = False
    start = inside & ~before
    word = np.cumsum(start) - 1
    count = int(start.sum())
    whole, raw = np.zeros(count + 1, bool), np.zeros(count + 1, bool)
    special = np.flatnonzero((data == 0x27) | (data == 0x3C))
    whole[word[special]] = True
    raw[word[np.flatnonzero(data == 0x3C)]] = True
    data = np.where(raw[word], data, LOWER[data]) if len(data) else data
    letter, sign = _LETTER[data], _SIGN[data]
    change = np.zeros(len(data), bool)
    change[1:] = (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
    change &= before & inside & ~whole[word] if len(data) else change
    starts = np.flatnonzero(start | change)
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    after[edge - 1] = False
    nxt = np.concatenate((change[1:], [False])) if len(data) else change
    ends = np.flatnonzero(inside & (~after | nxt)) + 1
    return data, starts, ends, np.searchsorted(starts, at)


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end and the ``n + 1`` places where each begins."""
    table = worker_state("units", path, lambda: Units(path))
    data, starts, ends, first = units(texts)
    hashes = rolling(BYTE_CODES[data], starts, ends)
    slot = table.slots(hashes, lambda i: data[starts[i]: ends[i]].tobytes().decode())
    sizes = table.at[slot + 1] - table.at[slot]
    ends_at = np.concatenate(([0], np.cumsum(sizes)))
    ids = table.ids[np.arange(ends_at[-1]) + np.repeat(table.at[slot] - ends_at[:-1], sizes)]
    return ids, ends_at[first]
