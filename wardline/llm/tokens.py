"""Encoding of a corpus with a public byte-level BPE (problem 6).

Texts are read once and encoded where they are read, without a shuffle. The splitting pattern keeps runs of letters,
digits, signs or blanks together, and the encoder's work on one unsplit run grows faster than its length. Every run over
``PIECE`` characters is therefore set apart and encoded by tree concatenation: it is cut into pieces, whose ids are found
independently, and neighbours are joined in pairs, level by level: around each join a growing window of ids
from both sides is encoded again until it begins with the left side's id and ends with the right side's. As a sequence of
ids is the encoding of its bytes exactly if each pair of neighbours is the encoding of theirs, the joined sequence is
exact. What lies between two such runs is encoded as it is; the encoder lets other threads run meanwhile, so the pieces of a
text with at least ``MANY`` of them are encoded by ``THREADS`` threads side by side.

Defined results: a null and an empty text give an empty list. All characters are plain text, also those of special
tokens. Repeated rows come out as often as they go in; a null id stays null. No rows, no result.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a piece, and of the longest run that is encoded as it is.
PIECE = 32
#: Pieces of a text from which threads encode them side by side, and how many threads.
MANY, THREADS = 4096, 4
#: Bytes that a vocabulary may have, as every task is sent it.
VOCABULARY_BYTES = 64 << 20


@lru_cache(maxsize=2)
def coder(ranks: bytes):
    """The encoder of a rank file's content."""
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def _sure(text: str) -> bool:
    """Whether every engine has the same classes for these characters; they may differ on characters new to Unicode."""
    return text.isascii() or all(unicodedata.category(c) != "Cn" for c in text)


_BLANK = regex.compile(r"\p{White_Space}")


@lru_cache(maxsize=8)
def _long_runs(piece: int) -> regex.Pattern:
    """Runs of letters, digits or signs, longer than a piece."""
    return regex.compile("|".join(rf"{kind}{{{piece + 1},}}+" for kind in (r"\p{L}", r"\p{N}", r"[^\p{White_Space}\p{L}\p{N}]")))


def cut(text: str, piece: int = PIECE) -> list[str | list[str]]:
    """Parts of a text in order: a text to be encoded as it is, or the pieces of one unsplit run.

    The pattern matches a run at once, with the one space that may stand before it; other blanks before a run are split
    from it, the last of them by itself. After a run the pattern begins anew. Letters after an apostrophe may lose some to
    it, so they make no run.
    """
    if max(map(len, text.split()), default=0) <= piece:  # a run has no blanks, so there is none
        return [text]
    out: list[str | list[str]] = []
    begin = 0
    for match in _long_runs(piece).finditer(text):
        start, end = match.span()
        if not _sure(text[max(start - 1, 0) : end + 1]) or start and text[start - 1] == "'":
            continue
        parts = []
        if start > begin and text[start - 1] == " ":
            start -= 1
        elif start > begin and _BLANK.match(text[start - 1]):
            parts = [text[start - 1]]
        before = text[begin : start - len(parts)]
        out += [x for x in (before, *parts) if x]
        out.append([text[at : min(at + piece, end)] for at in range(start, end, piece)])
        begin = end
    if begin < len(text):
        out.append(text[begin:])
    return out


def _boundary(byte: int) -> bool:
    """Whether a character begins at this byte."""
    return byte & 0xC0 != 0x80


def join(left: list[int], right: list[int], encoding) -> list[int]:
    """The ids of one unsplit run from the ids of its two parts."""
    window = 4
    while True:
        a, b = left[-window:], right[:window]
        whole = window >= len(left) and window >= len(right)
        data = encoding.decode_bytes(a + b)
        after = encoding.decode_single_token_bytes(right[window]) if window < len(right) else b""
        if whole or _boundary(data[0]) and (not after or _boundary(after[0])):
            ids = encoding.encode_ordinary(data.decode())
            left_agrees = window >= len(left) or ids[0] == a[0]
            right_agrees = window >= len(right) or ids[-1] == b[-1]
            if left_agrees and right_agrees and (len(ids) > 1 or whole):
                return left[: len(left) - len(a)] + ids + right[len(b) :]
        window *= 2


def join_tree(parts: list[list[int]], encoding) -> list[int]:
    """The ids of one unsplit run from those of all its parts, joined in pairs."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2], encoding) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def encode_text(text: str, encoding, piece: int = PIECE) -> list[int]:
    """The ids of a text."""
    parts = cut(text, piece)
    flat = [p for part in parts for p in ([part] if isinstance(part, str) else part)]
    ids = iter(encoding.encode_ordinary_batch(flat, num_threads=THREADS) if len(flat) >= MANY else map(encoding.encode_ordinary, flat))
    out: list[int] = []
    for part in parts:
        out += next(ids) if isinstance(part, str) else join_tree([next(ids) for _ in part], encoding)
    return out


def encode(docs: DataFrame, ident: str, text: str, ranks_path: str, piece: int = PIECE) -> DataFrame:
    """ident and ids (array<int>) of every row."""
    spark = docs.sparkSession
    with open(ranks_path, "rb") as file:
        ranks = file.read(VOCABULARY_BYTES + 1)
    if len(ranks) > VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to be sent to every task")
    sent = spark.sparkContext.broadcast(ranks)
    kind = docs.schema[ident].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = coder(sent.value)
        for batch in batches:
            ids = [encode_text(t, encoding, piece) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[ident, "ids"])

    return docs.select(F.col(ident), F.col(text)).mapInArrow(read, f"`{ident}` {kind}, ids array<int>")
