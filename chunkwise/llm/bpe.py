"""Byte-pair encoding and decoding by a pair occurrence index, equal to the tokenizers library's ids and texts.

All distinct words that are new in some millions of characters are merged
together: an index maps each pair's rank to all its positions, the active
ranks are taken in ascending order from a heap, and each merge updates only
the lists of the pairs that it touches.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import ragged
from .common import chunks, give_back, raw, small_batches
from .wordids import WordIds

#: New words are merged together once their texts reach this many bytes.
GROUP_BYTES = 2 << 20
#: The memory of encoded words is emptied beyond this many, so a worker stays small.
MOST_WORDS = 200_000
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class PairMerger:
    """Merges for byte sequences: ``first`` and ``last`` map bytes to symbols, ``merges`` lists (left, right, new) by rank."""

    def __init__(self, first: np.ndarray, last: np.ndarray, merges: np.ndarray, n_symbols: int):
        self.first, self.last, self.merges, self.n_symbols = first.astype(np.int32), last.astype(np.int32), merges, n_symbols
        keys = merges[:, 0].astype(np.int64) * n_symbols + merges[:, 1]
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE) if len(self.keys) else np.full(len(key), _NONE)

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all pieces, and how many each piece has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbol = self.first[data]
        tails = ends[lengths > 0] - 1
        symbol[tails] = self.last[data[tails]]
        n = len(data)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[tails] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(positions: np.ndarray) -> None:
            """Enter the pairs that start at ``positions`` in the index."""
            rank = self.ranks(symbol[positions], symbol[following[positions]])
            keep = rank != _NONE
            positions, rank = positions[keep], rank[keep]
            if not len(rank):
                return
            by = np.argsort(rank, kind="stable")
            positions, rank = positions[by], rank[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *cuts.tolist(), len(rank)]
            for r, a, b in zip(rank[starts[:-1]].tolist(), starts[:-1], starts[1:], strict=True):
                if r in index:
                    index[r].append(positions[a:b])
                else:
                    index[r] = [positions[a:b]]
                    heapq.heappush(active, r)

        note(np.flatnonzero(following >= 0))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            left, right, new = self.merges[rank].tolist()
            other = following[at]
            good = (symbol[at] == left) & (other >= 0)
            good[good] = symbol[other[good]] == right
            at = at[good]
            if left == right and len(at) > 1:  # of overlapping pairs, the leftmost first
                kept, taken = [], -1
                for p in np.sort(at).tolist():
                    if p != taken:
                        kept.append(p)
                        taken = following[p]
                at = np.array(kept)
            if not len(at):
                continue
            other = following[at]
            symbol[at], symbol[other] = new, -1
            after = following[other]
            following[at] = after
            more = after >= 0
            before[after[more]] = at[more]
            earlier = before[at]
            note(np.unique(np.concatenate([earlier[earlier >= 0], at[more]])))
        alive = symbol >= 0
        sums = np.concatenate([[0], np.cumsum(alive)])
        return symbol[alive], sums[ends] - sums[ends - lengths]


class Vocabulary:
    """A byte-level BPE vocabulary with word ends, read from the tokenizers library's JSON."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        rows = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int32).reshape(-1, 3)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {t.encode(): i for t, i in special.items()}
        self.tokens = np.array([b""] * (1 + max([*vocab.values(), *special.values()])), object)
        for text, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = text.encode()
        self.merger = PairMerger(np.array([vocab[x] for x in letters]), np.array([vocab[x + end] for x in letters]), rows, len(self.tokens))
        self.cut_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")")
        [pattern] = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.spaces = regex.compile(r"\p{White_Space}+")

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = self.spaces.sub(" ", unicodedata.normalize("NFC", text))
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def split(self, word: bytes) -> list[bytes]:
        """Pre-tokens as bytes; special tokens stay whole, in their own spelling."""
        if b"<|" not in word:
            return [p.encode() for p in self.pieces(self.normal(word.decode()))]
        out: list[bytes] = []
        for part in self.cut_special.split(word.decode()):
            if part.encode() in self.special:
                out.append(part.encode())
            else:
                out += [p.encode() for p in self.pieces(self.normal(part))]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        numbers: dict[bytes, int] = {}
        parts: list[int] = []
        sizes = np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            pieces = self.split(word)
            sizes[i] = len(pieces)
            for p in pieces:
                parts.append(numbers.setdefault(p, len(numbers)))
        pieces = list(numbers)
        ids, counts = self.merger([b"" if p in self.special else p for p in pieces])
        if any(p in self.special for p in pieces):  # a piece without bytes got no symbol
            at = np.array([i for i, p in enumerate(pieces) if p in self.special])
            ids = np.insert(ids, (np.cumsum(counts) - counts)[at], [self.special[pieces[i]] for i in at.tolist()])
            counts[at] = 1
        offsets = np.concatenate([[0], np.cumsum(counts)])
        which = np.array(parts, np.int64)
        out = ids[ragged(offsets[which], counts[which])]
        sums = np.concatenate([[0], np.cumsum(counts[which])])
        return out, np.diff(sums[np.concatenate([[0], np.cumsum(sizes)])])


@lru_cache(maxsize=2)
def _memory(path: str) -> tuple[Vocabulary, WordIds, list[bytes]]:
    vocabulary = Vocabulary(path)
    return vocabulary, WordIds(vocabulary.encode, MOST_WORDS), []


def encode_decode(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Encode each text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded).

    Null or empty text has no ids and decodes to the empty text.  Rows with a
    null doc_id and repeated rows are kept; other columns are dropped.  One
    pass without a shuffle; memory is bounded by the Arrow chunks and the
    bounded memory of encoded words, and a lost task is simply run again.
    """
    small_batches(docs.sparkSession)

    def results(held: list) -> Iterator[pa.RecordBatch]:
        words_of, memory, texts = _memory(vocabulary)
        memory.flush()
        sums = memory.offsets
        for a, b in zip(sums[len(texts) : -1].tolist(), sums[len(texts) + 1 :].tolist(), strict=True):
            texts.append(b" ".join(words_of.tokens[memory.ids[a:b]]))
        for doc_ids, numbers, bounds in held:
            ids, counts = memory.texts(numbers, bounds)
            ends = np.cumsum(counts)
            code = ids.astype("<u4").tobytes()
            spans = [code[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            words = [numbers[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            decoded = [b" ".join([t for t in map(texts.__getitem__, w.tolist()) if t]) for w in words]
            columns = [doc_ids, pa.array(counts), pa.array([hashlib.sha256(x).hexdigest() for x in spans]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(spans, pa.binary()), pa.array([x.decode() for x in decoded], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)
        if memory.full():
            memory.clear()
            texts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(vocabulary)[1]
        memory.clear()
        _memory(vocabulary)[2].clear()
        held, size = [], 0
        for table in chunks(batches):
            data, offsets = raw(table["text"])
            held.append((table["doc_id"].combine_chunks(), *memory.words(data, offsets)))
            size += len(data)
            if size >= GROUP_BYTES:
                yield from results(held)
                held, size = [], 0
        if held:
            yield from results(held)
        memory.clear()  # a reused worker keeps no words of an earlier task
        _memory(vocabulary)[2].clear()
        give_back()

    extra = ", ids binary, decoded string" if with_ids else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)
