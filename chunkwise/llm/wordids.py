"""Token ids of whole texts by way of their distinct words.

The vocabulary's normaliser and pre-tokenizer never join what white space
parts, so a text's ids are the ids of its words one after another; each
distinct word is encoded once and remembered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .bytesets import LOWER, prefix_hashes, ragged, span_hashes, word_spans

_STOP, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".,")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True

#: The memory of encoded words is emptied beyond this many, which costs time only.
MOST_WORDS = 600_000


class WordIds:
    """``encode`` gets distinct words as UTF-8 byte strings; returns all ids, and each word's number of ids.

    ``words`` numbers the words of some texts; ``flush`` encodes the words
    that are new since the last flush; ``texts`` then gives the texts' ids.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = MOST_WORDS):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.new: list[bytes] = []
        self.ids = np.zeros(0, np.uint32)
        self.offsets = np.zeros(1, np.int64)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the texts its number, and the bounds of the texts among the words."""
        if not self.marked(data):
            data = LOWER[data]
        starts, ends, bounds = self.pieces(data, offsets)
        hashes = span_hashes(prefix_hashes(data), starts, ends)
        order = np.argsort(hashes)
        ordered = hashes[order]
        change = np.ones(len(order), bool)
        change[1:] = ordered[1:] != ordered[:-1]
        unique, first = ordered[change], order[change]
        inverse = np.empty(len(order), np.int32)
        inverse[order] = np.cumsum(change, dtype=np.int32) - 1
        known, get = self.known, self.known.get
        numbers = np.array([get(h, -1) for h in unique.tolist()], np.int32)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            text = data.tobytes()
            self.new += [text[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            numbers[new] = np.arange(len(known), len(known) + len(new))
            known.update(zip(unique[new].tolist(), numbers[new].tolist(), strict=True))
        return numbers[inverse], bounds

    @staticmethod
    def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, but a last "." or "," after A-Z or a-z is a piece of its own, as it is to the pre-tokenizer."""
        starts, ends, bounds = word_spans(data, offsets)
        tail = np.flatnonzero((ends - starts > 1) & _STOP[data[ends - 1]])
        tail = tail[_LETTER[data[ends[tail] - 2]]]
        counts = np.ones(len(starts), np.int64)
        counts[tail] = 2
        at = np.concatenate([[0], np.cumsum(counts)])
        begin, end = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
        begin[at[:-1]], end[at[:-1]] = starts, ends
        end[at[tail]] = begin[at[tail] + 1] = ends[tail] - 1
        end[at[tail] + 1] = ends[tail]
        return begin, end, at[bounds]

    @staticmethod
    def marked(data: np.ndarray) -> bool:
        """Whether a special token may be near: only then does the case of A-Z matter."""
        return bool(np.any((data[:-1] == 0x3C) & (data[1:] == 0x7C)))

    def flush(self) -> None:
        if self.new:
            ids, counts = self.encode(self.new)
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            self.new = []

    def full(self) -> bool:
        return len(self.known) > self.most

    def texts(self, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        starts = self.offsets[:-1][numbers]
        counts = self.offsets[1:][numbers] - starts
        sums = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[ragged(starts, counts)], np.diff(sums[bounds])
