"""Operator 8: token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton finds every vocabulary piece in a chunk of text; a Viterbi pass
over the places where pieces end carries the best score and, with it, how many pieces the
best path has. No path is stored or traced back. Ties are broken as the tokenizers library
breaks them in its unigram model: of equal scores the piece that starts first stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import held, text_runs

SPACE = "▁"
#: How far below the vocabulary's least score an unknown character's score lies.
UNKNOWN_PENALTY = 10.0


def pieces_of(model_file: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores of a sentencepiece file, and the place of the unknown piece.

    Control and byte pieces cannot match text; their place stays, under a name that no text has.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    usable = lambda i: not (model.is_control(i) or model.is_byte(i))
    return [(model.id_to_piece(i) if usable(i) else f"\x00{i}", model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class CountingViterbi:
    """Counts the unigram pieces of chunks, each of which is a text's word with its leading mark.

    ``pieces`` are (piece, score); that at ``unknown`` stands for characters without a piece,
    and neighbours among these count once. Empty pieces match nothing. The memo of chunks is
    emptied when it holds ``capacity`` of them or ``max_chars`` characters.
    """

    def __init__(self, pieces: list[tuple[str, float]], unknown: int, capacity: int = 500_000, max_chars: int = 32 << 20):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if piece and i != unknown:
                self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self._capacity, self._max_chars = capacity, max_chars
        self._memo: dict[str, int] = {}
        self._chars = 0

    def chunk(self, chunk: str) -> tuple[int, float]:
        """How many pieces the best path through ``chunk`` has, and its score."""
        n = len(chunk)
        best, count, reached = [0.0] * (n + 1), [0] * (n + 1), [True] + [False] * n
        lone = [False] * (n + 1)  # whether the best path ends in an unknown character
        found = self._automaton.iter(chunk)
        match = next(found, None)
        for end in range(1, n + 1):
            known = False
            while match is not None and match[0] == end - 1:
                length, score = match[1]
                start = end - length
                known |= length == 1
                if (total := best[start] + score) > best[end] or not reached[end]:
                    best[end], count[end], lone[end], reached[end] = total, count[start] + 1, False, True
                match = next(found, None)
            if not known and ((total := best[end - 1] + self._unknown) > best[end] or not reached[end]):
                best[end], count[end], lone[end], reached[end] = total, count[end - 1] + (not lone[end - 1]), True, True
        return count[n], best[n]

    def count(self, texts: pa.Array) -> np.ndarray:
        """How many pieces each text has; spaces become marks, and each text gets one before it."""
        if len(self._memo) > self._capacity or self._chars > self._max_chars:
            self._memo, self._chars = {}, 0
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = pc.replace_substring(texts, " ", SPACE)
        bare = pc.and_(pc.invert(pc.starts_with(marked, SPACE)), pc.not_equal(marked, ""))
        marked = pc.if_else(bare, pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), marked, pa.scalar("", pa.large_string())), marked)
        split = pc.split_pattern(marked, SPACE)
        coded = split.values.dictionary_encode()
        memo, own = self._memo, np.empty(len(coded.dictionary), np.int64)
        for i, rest in enumerate(coded.dictionary.to_pylist()):
            if (n := memo.get(rest)) is None:
                n = memo[rest] = self.chunk(SPACE + rest)[0]
                self._chars += len(rest)
            own[i] = n
        each = np.concatenate([[0], np.cumsum(own[coded.indices.to_numpy()] if len(coded) else own)])
        offsets = split.offsets.to_numpy()
        first = offsets[:-1]  # what stands before the first mark, which is nothing
        return each[offsets[1:]] - each[np.minimum(first + 1, offsets[1:])]


def count_tokens(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id and n_tokens of the whole text.

    ``model_file`` is a sentencepiece file, whose pieces and scores are the unigram vocabulary.
    A null or empty text has no tokens; a very long one is counted whole. Rows that repeat a
    doc_id, or have none, each get their count. Other columns are ignored; an empty table gives
    an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(model_file, lambda: CountingViterbi(*pieces_of(model_file)))
        for batch in batches:
            for part in text_runs(batch, "text", 4 << 20):
                yield pa.record_batch([part.column("doc_id"), pa.array(counter.count(part.column("text")), pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")
