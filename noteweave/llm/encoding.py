"""Token ids of whole texts by a public byte-level BPE tokenizer, as a monoid tree reduction.

A text is halved until its pieces are short, the pieces are encoded, and neighbours are joined up the
tree. A join re-encodes a window around the seam, which grows to both sides until it ends at places
where tokens provably end in any context; the tokens outside it stay. Such a place lies between a
character that isn't white space and one that is: every alternative of the tokenizer's splitting pattern
matches either white space only or at most one space followed by other characters, so no piece that BPE
works on reaches across it, and how the text splits after it depends on what follows only.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie, and the one that is used.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k"
#: Fixed value: the splitting pattern of the tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the characters that \s stands for in it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Pieces of at most so many characters are encoded at once.
LEAF = 1024

_SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


class TreeCodec:
    """Encodes by the tree, and decodes by concatenation up the tree."""

    def __init__(self, vocabulary: str, leaf: int = LEAF):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece, self.leaf = self.bpe.encode_ordinary, leaf

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text`` without special tokens; null and empty texts have none."""
        if not text:
            return []
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.piece(text[start:end])
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self._tree(text, start, middle), self._tree(text, middle, end))

    def join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[start:end] from those of its halves."""
        width = 16
        while True:
            low, high = max(start, middle - width), min(end, middle + width)
            seams = [m.start() + low for m in _SAFE.finditer(text[low:high])]
            before = next((p for p in reversed(seams) if p <= middle), start if low == start else None)
            after = next((p for p in seams if p >= middle), end if high == end else None)
            if before is not None and after is not None:
                break
            width *= 2
        if before == after:
            return left + right
        # a half's tokens inside the window are the encoding of the window's part in it
        keep = len(left) - (len(self.piece(text[before:middle])) if before < middle else 0)
        skip = len(self.piece(text[middle:after])) if after > middle else 0
        return left[:keep] + self.piece(text[before:after]) + right[skip:]

    def decode(self, ids: list[int]) -> str:
        return self._bytes(ids, 0, len(ids)).decode("utf-8", "replace")

    def _bytes(self, ids: list[int], start: int, end: int) -> bytes:
        """The bytes of ids[start:end]: those of its halves, one after the other."""
        if end - start <= self.leaf:
            return self.bpe.decode_bytes(ids[start:end])
        middle = (start + end) // 2
        return self._bytes(ids, start, middle) + self._bytes(ids, middle, end)


_codecs: dict[str, TreeCodec] = {}


def codec(name: str) -> TreeCodec:
    """One codec per worker and vocabulary file, which Spark has sent to the worker's machine."""
    if name not in _codecs:
        _codecs[name] = TreeCodec(SparkFiles.get(name))
    return _codecs[name]


def _sent(df: DataFrame, folder: str, tokenizer: str) -> str:
    """The name under which all workers get a vocabulary file."""
    name = f"{tokenizer}.tiktoken"
    df.sparkSession.sparkContext.addFile(f"{folder}/{name}")
    return name


def encode_corpus(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE_50K, folder: str = TOKENIZERS) -> DataFrame:
    """``key``, ids array<int> of every row: the token ids of the whole text, without special tokens.

    Empty and null texts give an empty list. Repeated rows and null keys stay as they are; other columns
    are ignored. Strings of special tokens in a text are ordinary text. No row moves: each worker encodes
    the rows of its own split.
    """
    vocabulary = _sent(docs, folder, tokenizer)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(vocabulary).encode
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                ids = [np.fromiter(encode(t), np.int32) for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "ids"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {key_type}, ids array<int>")


def decode_corpus(encoded: DataFrame, *, key: str = "doc_id", ids: str = "ids", tokenizer: str = BYTE_BPE_50K, folder: str = TOKENIZERS) -> DataFrame:
    """``key``, text of every row; a null list gives a null text, an empty one an empty text."""
    vocabulary = _sent(encoded, folder, tokenizer)
    key_type = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(vocabulary).decode
        for batch in batches:
            texts = [None if x is None else decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {key_type}, text string")
