"""Token ids of whole texts by the ``tokenizers`` library, with a bounded memo of chunks.

The vocabulary drops white space before it splits, so ids never depend on what is on
the other side of a space or line feed: a text's ids are those of its chunks, joined.
Each distinct chunk is encoded by the library once for as long as the memo holds it.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .runtime import held

DEFAULT_VOCABULARY = "word_bpe_49k.json"
SEPARATOR = "|"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _loosened(texts: pa.Array) -> pa.Array:
    """Texts with the same ids but fewer distinct chunks.

    Line feeds become spaces. A to Z become lower case, as the vocabulary does itself, but not
    in a text where that could write a special token, which starts with ``<|``, or where a mark
    follows a capital: the vocabulary composes before it lowers, and some small letters have a
    composed form that the capital lacks. Signs between a small letter and a space get a space
    before them: signs and letters never share a piece, unless an apostrophe comes before.
    """
    texts = pc.replace_substring(texts, "\n", " ")
    texts = pc.if_else(pc.match_substring_regex(texts, r"<\||[A-Z]\p{M}"), texts, pc.ascii_lower(texts))
    return pc.replace_substring_regex(texts, r"([\p{Ll}0-9])([!-&(-;=?@\[-`{}~]+) ", r"\1 \2 ")


def shared_tokenizer(path: str, capacity: int) -> ChunkTokenizer:
    """This process's tokenizer of a file: tasks that follow in one worker find the memo filled."""
    return held((path, capacity), lambda: ChunkTokenizer(path, capacity))


_DRAW = np.random.default_rng(29)
_PLACES = _DRAW.integers(1, 1 << 63, (2, 64), np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0xD1342543DE82EF95)


def chunk_keys(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text: sums of its bytes, each times a number drawn for its place."""
    ends = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
    sizes, total = np.diff(ends), int(ends[-1] - ends[0])
    if not total:
        return np.zeros(len(chunks), np.uint64), np.zeros(len(chunks), np.uint64)
    byte = np.frombuffer(chunks.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    place = np.arange(total) - np.repeat(ends[:-1] - ends[0], sizes)
    if (far := int(place.max()) >> 6) > 0:
        byte *= np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(far, _ODD)]))[place >> 6]
    place &= 63
    full, out = np.flatnonzero(sizes), []
    for drawn in _PLACES:
        key = np.zeros(len(chunks), np.uint64)
        key[full] = np.add.reduceat(byte * drawn[place], (ends[:-1] - ends[0])[full])
        key = (key ^ sizes.astype(np.uint64) * _ODD) * drawn[0]
        out.append((key ^ key >> np.uint64(32)) * drawn[1])
    return out[0], out[1]


class Memo:
    """Numbers from 0 for chunks, by their two hashes, in a table of open addresses."""

    def __init__(self, bits: int = 15):
        self._bits = bits
        self._slots = np.full(1 << bits, -1, np.int32)
        self._keys = np.empty((2, 1 << bits >> 1), np.uint64)
        self.size = 0

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each chunk's number, or -1."""
        out, left = np.full(len(a), -1, np.int32), np.arange(len(a))
        slot = (a >> np.uint64(64 - self._bits)).astype(np.int64)
        while len(left):
            at = self._slots[slot]
            full = at >= 0
            left, slot, at = left[full], slot[full], at[full]
            same = (self._keys[0][at] == a[left]) & (self._keys[1][at] == b[left])
            out[left[same]] = at[same]
            left, slot = left[~same], (slot[~same] + 1) & ((1 << self._bits) - 1)
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Number distinct new chunks, in order."""
        n = self.size + len(a)
        if 2 * n > 1 << self._bits:
            more = Memo(max(self._bits + 1, (2 * n).bit_length()))
            more._put(*self._keys[:, : self.size])
            self._bits, self._slots, self._keys = more._bits, more._slots, more._keys
        self._put(a, b)

    def _put(self, a: np.ndarray, b: np.ndarray) -> None:
        new = np.arange(self.size, self.size + len(a), dtype=np.int32)
        self._keys[:, new] = a, b
        self.size += len(a)
        slot = (a >> np.uint64(64 - self._bits)).astype(np.int64)
        while len(new):
            free = self._slots[slot] < 0
            self._slots[slot[free]] = new[free]
            left = self._slots[slot] != new
            new, slot = new[left], (slot[left] + 1) & ((1 << self._bits) - 1)

    def only(self, kept: np.ndarray) -> Memo:
        """The chunks of these numbers, numbered anew."""
        out = Memo()
        out.add(*self._keys[:, kept])
        return out


class ChunkTokenizer:
    """Encodes texts with a tokenizer file whose normaliser drops white space.

    ``capacity`` bounds the chunks that the memo keeps, ``max_ids`` their ids. Chunks are told
    apart by 128 bits of hashes. ``size`` is greater than every id.
    """

    def __init__(self, path: str, capacity: int = 600_000, max_ids: int = 16 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.size = tokenizer.get_vocab_size()
        self._encode = tokenizer.encode_batch_fast
        self._capacity, self._max_ids = capacity, max_ids
        (self._separator_id,) = self._encode([SEPARATOR], add_special_tokens=False)[0].ids
        self._clear()

    def _clear(self) -> None:
        self._memo = Memo()
        self._used = 0
        self._ids = np.empty(1 << 16, np.uint32)
        self._starts = np.empty(1 << 14, np.int64)
        self._lengths = np.empty(1 << 14, np.int64)
        self._seen = np.zeros(1 << 14, np.int32)  # in how many runs of texts

    def _trim(self) -> None:
        """Make room: chunks of one run of texts alone go, and beyond half the capacity the rarest."""
        n = self._memo.size
        keep = np.flatnonzero(self._seen[:n] > 1)
        if len(keep) > self._capacity // 2:
            keep = np.sort(keep[np.argpartition(-self._seen[keep], self._capacity // 2)[: self._capacity // 2]])
        lengths = self._lengths[keep]
        if lengths.sum() > self._max_ids // 2:
            self._clear()
            return
        ids = self._ids[np.repeat(self._starts[keep] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]
        self._memo, self._used = self._memo.only(keep), len(ids)
        self._ids, self._lengths, self._starts, self._seen = ids, lengths, np.cumsum(lengths) - lengths, self._seen[keep] // 2

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n > len(a):
            a = np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])
        return a

    def _chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, joined, and how many each has.

        Chunks go to the library many at a time with a lone separator between them. Its id
        comes from its own character only, so chunks that hold that character go alone.
        """
        alone = [i for i, c in enumerate(chunks) if SEPARATOR in c]
        if alone:
            parts, taken = [], set(alone)
            parts.append([e.ids for e in self._encode([chunks[i] for i in alone], add_special_tokens=False)])
            rest = [i for i in range(len(chunks)) if i not in taken]
            ids, counts = self._chunk_ids([chunks[i] for i in rest])
            all_ids: list = [None] * len(chunks)
            for i, x in zip(alone, parts[0]):
                all_ids[i] = x
            for i, x in zip(rest, np.split(ids, np.cumsum(counts)[:-1]) if rest else []):
                all_ids[i] = x
            return np.concatenate([np.asarray(x, np.uint32) for x in all_ids]), np.array([len(x) for x in all_ids], np.int64)
        if not chunks:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        gap = f" {SEPARATOR} "
        runs = [gap.join(chunks[i : i + 64]) + gap for i in range(0, len(chunks), 64)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self._encode(runs, add_special_tokens=False)), np.uint32)
        stop = ids == self._separator_id
        counts = np.diff(np.concatenate([[-1], np.flatnonzero(stop)])) - 1
        if len(counts) != len(chunks):
            raise ValueError("this tokenizer does not drop white space, so its chunks cannot be encoded apart")
        return ids[~stop], counts

    def _learn(self, chunks: list[str]) -> None:
        known = self._memo.size
        for at in range(0, len(chunks), 50_000):
            part = chunks[at : at + 50_000]
            ids, lengths = self._chunk_ids(part)
            total = len(ids)
            self._ids = self._room(self._ids, self._used + total)
            self._starts = self._room(self._starts, known + len(part))
            self._lengths = self._room(self._lengths, known + len(part))
            self._seen = self._room(self._seen, known + len(part))
            self._seen[known : known + len(part)] = 0
            self._ids[self._used : self._used + total] = ids
            self._lengths[known : known + len(part)] = lengths
            self._starts[known : known + len(part)] = self._used + np.cumsum(lengths) - lengths
            known += len(part)
            self._used += total

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has; ``end_id`` closes each.

        A null text is empty.
        """
        if self._memo.size > self._capacity or self._used > self._max_ids:
            self._trim()
        split = pc.split_pattern(_loosened(pc.fill_null(texts.cast(pa.large_string()), "")), " ")
        ends = split.offsets.to_numpy()[1:]
        coded = split.values.dictionary_encode()
        distinct = coded.dictionary
        keys = chunk_keys(distinct)
        place_of = self._memo.find(*keys)
        new = np.flatnonzero(place_of < 0)
        place_of[new] = np.arange(self._memo.size, self._memo.size + len(new))
        self._learn(distinct.take(pa.array(new)).to_pylist())
        self._memo.add(keys[0][new], keys[1][new])
        self._seen[place_of] += 1
        at = place_of[coded.indices.to_numpy()]
        lengths = self._lengths[at]
        before = np.concatenate([[0], np.cumsum(lengths)])
        kind = np.int32 if max(before[-1], self._used) < 1 << 31 else np.int64
        place = np.repeat((self._starts[at] - before[:-1]).astype(kind), lengths)
        place += np.arange(before[-1], dtype=kind)
        ids = self._ids[place]
        counts = np.diff(before[np.concatenate([[0], ends])])
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
            counts = counts + 1
        return ids, counts
