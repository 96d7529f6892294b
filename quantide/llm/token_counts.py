"""Token counts of a unigram tokenizer without building its tokens.

Segmentation by a unigram model is a best path over piece scores. Here an
Aho-Corasick automaton enumerates the vocabulary's matches in a segment, ordered by
end and then from the longest, and dynamic programming keeps for every end only
the best score and the number of pieces on the path to it: no lattice, no tokens.

Rules of the tokenizers library's unigram model, kept exactly: scores add up from
the left in double precision; of paths with equal scores into one end, that with
the longest last piece wins; a character that no one-character piece covers may also
be unknown, at ten below the lowest score; unknown characters fall back to one piece
per UTF-8 byte. Spaces become the mark U+2581, which also starts the text; segments
start at marks and no piece crosses one, so counts of segments add up and are
remembered, up to a bounded number of segments.

The vocabulary is that of a public SentencePiece file, whose path is a parameter.
Its pieces are ordered by frequency of merging; as unigram scores they get the
log-probabilities of Zipf's law at their rank. Nothing is trained.

Defined results: a null text counts as empty and has no tokens; rows are counted one
by one, so repeated rows and ids get equal results; long texts and segments are
counted whole; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantide.llm.common import table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: segments whose counts a worker remembers before it starts anew
REMEMBERED = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in the file's order; a piece's score is the log of its share under Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = [i for i in range(len(pieces)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    norm = math.log(sum(1 / r for r in range(1, len(plain) + 1)))
    score = {i: -math.log(r) - norm for r, i in enumerate(plain, 1)}
    lowest = min(score.values())
    return [(p, score.get(i, lowest)) for i, p in enumerate(pieces)]


class Counter(dict):
    """Segment (without its mark) -> number of pieces; computes what it doesn't hold."""

    def __init__(self, vocabulary: list[tuple[str, float]], remembered: int = REMEMBERED):
        super().__init__()
        present = {p for p, _ in vocabulary}
        if any(f"<0x{b:02X}>" not in present for b in range(256)):
            raise ValueError("the vocabulary lacks pieces for bytes")
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.remembered = remembered

    def __missing__(self, word: str) -> int:
        n = self.pieces(MARK + word)
        if len(word) <= 64:
            if len(self) >= self.remembered:
                self.clear()
            self[word] = n
        return n

    def pieces(self, segment: str) -> int:
        best, count = [0.0], [0]
        now, single, top, number = 1, False, None, 0
        for end, (length, score) in self.automaton.iter(segment):
            while now <= end:
                self._close(segment, best, count, now, single, top, number)
                now, single, top = now + 1, False, None
            start = now - length
            path = best[start] + score
            if top is None or path > top:
                top, number = path, count[start] + 1
            single = single or length == 1
        while now <= len(segment):
            self._close(segment, best, count, now, single, top, number)
            now, single, top = now + 1, False, None
        return count[-1]

    def _close(self, segment: str, best: list[float], count: list[int], now: int, single: bool, top: float | None, number: int) -> None:
        if not single:
            path = self.unknown + best[now - 1]
            if top is None or path > top:
                top, number = path, count[now - 1] + len(segment[now - 1].encode())
        best.append(top)
        count.append(number)

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:
            del words[0]
        return sum(map(self.__getitem__, words))


@functools.cache
def counter(path: str) -> Counter:
    return Counter(zipf_vocabulary(path))


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and n_tokens of each row; ``path`` is the vocabulary file on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path or default_vocabulary())
        for batch in batches:
            n = pa.array([counts.text(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=[key, "n_tokens"])

    kind = dict(docs.select(key).dtypes)[key]
    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
