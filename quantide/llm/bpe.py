"""BPE encoding and decoding of whole texts by tree concatenation.

A byte-level BPE first splits text into pieces by a pattern, then merges bytes
inside each piece. Two facts let long texts be encoded in parts, exactly:

* The pattern never joins a non-space to a white-space character after it, so a
  long text may be cut there; halves encode independently.
* Inside one long piece that the pattern leaves unsplit, a token sequence is the
  encoding if and only if each pair of neighbours is the encoding of its own
  text. So the two halves are encoded on their own and a window around the join is
  encoded anew, growing on either side until its first and last token equal what
  that side already had. All pairs are then valid ones, and so is the whole.

Leaves are encoded in parallel (threads in native code), joins pairwise up the
tree. The vocabulary is read from the tokenizer's JSON file, whose path is a
parameter; added special tokens found in a text become their ids, as that
tokenizer does.

Defined results: a null text counts as empty (no tokens, empty text back); rows
are encoded one by one, so repeated rows and ids get equal results; an empty table
gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantide.llm.common import table

#: texts longer than this many characters are halved; pieces longer than this many bytes are encoded as trees
TEXT_LEAF = 32_768
PIECE_LEAF = 512
#: The byte-level pre-tokenizer's published pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=[^\s])(?=[ \n\t\r])")


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, by its public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain}
    chars.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return chars


def may_hold_unsplit(text: str, least: int = PIECE_LEAF) -> bool:
    """Whether a run of ``least`` non-space or white-space characters is possible; never wrongly False."""
    words = text.split()
    lengths = list(map(len, words))
    return max(lengths, default=0) >= least or len(text) - sum(lengths) - (len(words) - 1) >= least


class TreeBPE:
    """Encoder and decoder over the vocabulary of a byte-level BPE tokenizer file."""

    def __init__(self, path: str, text_leaf: int = TEXT_LEAF, piece_leaf: int = PIECE_LEAF, threads: int = 2):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        chars = byte_alphabet()
        ranks = {bytes(chars[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        # ranks must order merges as the file does: true where ids were given in the order of merging
        words = spec["model"]["vocab"]
        merged = [words["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in spec["model"]["merges"]]
        if sorted(ranks.values())[256:] != merged:
            raise ValueError("this vocabulary doesn't number its tokens in the order of merging")
        self.native = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = special
        self.find_special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pieces = regex.compile(PATTERN)
        self.text_leaf, self.piece_leaf, self.threads = text_leaf, piece_leaf, threads

    # -- one long piece -------------------------------------------------------------

    def _merge(self, data: bytes) -> list[int]:
        return self.native._encode_single_piece(data)

    def _bytes(self, ids: list[int]) -> bytes:
        return self.native.decode_bytes(ids)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded halves' concatenation."""
        if not left or not right:
            return left + right
        a = b = 1
        while True:
            window = self._merge(self._bytes(left[-a:]) + self._bytes(right[:b]))
            left_agrees = a == len(left) or window[0] == left[-a]
            right_agrees = b == len(right) or window[-1] == right[b - 1]
            # one token over both ends can agree with neither
            if left_agrees and right_agrees and (len(window) > 1 or a == len(left) and b == len(right)):
                return left[: len(left) - a] + window + right[b:]
            if (not left_agrees or len(window) == 1) and a < len(left):
                a = min(len(left), 2 * a)
            if (not right_agrees or len(window) == 1) and b < len(right):
                b = min(len(right), 2 * b)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return self.native.encode_ordinary_batch(texts, num_threads=self.threads)

    def encode_piece(self, data: bytes) -> list[int]:
        """A tree over a piece that the pattern leaves unsplit; it leaves parts of it unsplit too."""
        if len(data) <= self.piece_leaf:
            return self._merge(data)
        cuts = [0]
        while cuts[-1] < len(data):
            at = min(cuts[-1] + self.piece_leaf, len(data))
            # not inside a character
            while at < len(data) and data[at] & 0xC0 == 0x80:
                at += 1
            cuts.append(at)
        parts = self._batch([data[a:b].decode() for a, b in zip(cuts, cuts[1:])])
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    # -- texts ------------------------------------------------------------------------

    def _leaf(self, text: str) -> list[int]:
        """Text without special tokens, at most a leaf long unless it can't be cut."""
        if not may_hold_unsplit(text, self.piece_leaf):
            return self.native.encode_ordinary(text)
        out: list[int] = []
        for piece in self.pieces.findall(text):
            out += self.encode_piece(piece.encode())
        return out

    def halves(self, text: str) -> list[str]:
        """Leaves of a long text, cut near the middle again and again where the pattern always splits."""
        if len(text) <= self.text_leaf:
            return [text]
        mid = len(text) // 2
        after = _CUT.search(text, mid)
        at = after.start() if after else None
        if at is None or at >= len(text):
            before = [m.start() for m in _CUT.finditer(text, max(0, mid - self.text_leaf), mid)] or [m.start() for m in _CUT.finditer(text, 0, mid)]
            at = before[-1] if before else None
        if not at:
            return [text]
        return self.halves(text[:at]) + self.halves(text[at:])

    def encode_plain(self, text: str) -> list[int]:
        if len(text) <= self.text_leaf:
            return self._leaf(text)
        leaves = self.halves(text)
        unsplit = [may_hold_unsplit(x, self.piece_leaf) for x in leaves]
        others = iter(self._batch([x for x, long in zip(leaves, unsplit, strict=True) if not long]))
        return [i for x, long in zip(leaves, unsplit, strict=True) for i in (self._leaf(x) if long else next(others))]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.find_special is None or not any(s in text for s in self.special):
            return self.encode_plain(text)
        out, at = [], 0
        for m in self.find_special.finditer(text):
            out += self.encode_plain(text[at : m.start()]) if m.start() > at else []
            out.append(self.special[m.group()])
            at = m.end()
        return out + (self.encode_plain(text[at:]) if at < len(text) else [])

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The text in UTF-8, special tokens written out; bytes that are no UTF-8 become U+FFFD."""
        return self.native.decode_bytes(ids).decode("utf-8", "replace").encode()


@functools.cache
def encoder(path: str) -> TreeBPE:
    return TreeBPE(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each row's text.

    ``path`` is the tokenizer file on the executors; by default the installed public one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path or default_vocabulary())
        names = [str(i) for i in range(bpe.native.n_vocab)]
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py())
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.select(key).dtypes)[key]
    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, text: str = "text", path: str | None = None, into: str = "token_ids") -> DataFrame:
    """All rows and columns with the token ids added as an array."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path or default_vocabulary())
        for batch in batches:
            ids = pa.array([bpe.encode(t.as_py()) for t in batch.column(at)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*names, into])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{into}` array<int>")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
