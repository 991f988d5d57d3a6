"""Evaluation texts leaking into training text (problem 7).

A passage leaks into a text that holds at least half of its words in runs of at least eight successive words, in the
passage's order. Each run holds a shingle of eight words. A first pass over the corpus counts in how many texts each of
the passages' shingles stands; this rarity orders each passage's shingles. A leaked passage shares at least a known
number of places of shingles, so all but the most frequent of that number form a prefix of which one must be met. A
second pass takes only texts that meet a prefix shingle, and of these the stretches of words that passages may share. Texts
and passages are joined on prefix shingles; pairs whose text is too short, or holds too few places of the passage's
shingles, drop out, and the others are verified exactly, word by word: the best chain of runs, in order in passage and
text, is found within windows about the places that the two share.

Passages are read, like the texts, by all tasks, and joined with shingles in a shuffle. What the tasks are sent is a bit
map of ``FILTER_BITS`` bits of the shingles' hashes, its size the same for any number of passages; it only thins out
what goes into the joins. So the corpus is passed over twice, however many passages there are.

Words are what blanks separate, in lower case, after markup is dropped and compatibility forms are decomposed, without
marks, invisible characters and punctuation on or inside them.

Defined results: a passage of fewer than eight words, an empty and a null passage leak nowhere; a null or empty text
holds nothing. Equal passages each give their own rows; repeated documents of one id give one row, for the text that
holds most. Items and documents without an id give none. Empty tables give no rows. Other columns take no part.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.session import settle

#: Words of the shortest run that counts.
RUN = 8
#: Bits of the map that thins out shingles; every task is sent two such maps.
FILTER_BITS = 1 << 25

_INLINE = regex.compile(r"</?(?:b|i|u|s|a|em|strong|span|sub|sup|small|mark|font|code)(?:\s[^<>]*)?>", regex.I)
# a longer stretch is a tag only with an attribute's value, so that prose after an unclosed bracket stays
_TAG = regex.compile(r"<(?:!--.*?--|[/!]?[a-zA-Z](?:[^<>]{0,200}|[\w:-]*+(?:\s+[\w:@-]+(?:\.[\w-]+)*+)++\s*=[^<>]*))>", regex.S)
_QUOTE = regex.compile(r"^[ \t]*(?:>[ \t]?)+", regex.M)
_BROKEN = regex.compile(r"(?<=\p{L})[-‐­]\s*[\r\n]+\s*(?=\p{Ll})")
_MARKS = regex.compile(r"[\p{M}\p{Cf}]+")
_OTHER = regex.compile(r"[^\p{L}\p{N}\s]+")
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 | 1 for i in range(RUN)], np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str) -> list[str]:
    """The words of a text in their comparable form."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if ">" in text:
        text = _QUOTE.sub("", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    if "-" in text or "‐" in text:
        text = _BROKEN.sub("", text)
    return _OTHER.sub("", text.casefold()).split()


def grams(words: list[str]) -> np.ndarray:
    """A hash of every run of RUN words."""
    n = len(words) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    mixed = np.fromiter(map(_word, words), np.uint64, len(words))
    total = np.zeros(n, np.uint64)
    for i in range(RUN):
        total += mixed[i : i + n] * _FACTORS[i]
    return ((total ^ (total >> np.uint64(31))) * _MIX).view(np.int64)


@lru_cache(maxsize=1 << 16)
def _word(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Filter:
    """A map of bits; a hash whose bit is not set is none of those it was made from."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def of(hashes: DataFrame, gram: str) -> Filter:
        """From a column of hashes. Words of 64 bits come to the driver, FILTER_BITS / 64 of them at most."""
        bit = F.col(gram).bitwiseAND(F.lit(FILTER_BITS - 1))
        words = hashes.select(F.shiftright(bit, 6).alias("at"), F.expr(f"shiftleft(1L, cast({gram} & 63 as int))").alias("word")).groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        bits = np.zeros(FILTER_BITS // 64, np.int64)
        bits[words["at"].to_numpy()] = words["word"].to_numpy()
        return Filter(bits)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        return (self.bits[(hashes & (len(self.bits) * 64 - 1)) >> 6] >> (hashes & 63)) & 1 == 1


def chain(points: list[tuple[int, int]]) -> int:
    """Most words of the passage in runs, in order in both; points: (place in the passage, place in the text) of shared shingles."""
    points = sorted(set(points))
    columns = sorted({p for _, p in points})
    rank = {p: i + 1 for i, p in enumerate(columns)}
    tree = [0] * (len(columns) + 1)
    best: dict[tuple[int, int], int] = {}
    waiting = 0
    for q, p in points:
        while points[waiting][0] + RUN <= q:
            done = points[waiting]
            i, value = rank[done[1]], best[done]
            while i < len(tree):
                tree[i] = max(tree[i], value)
                i += i & -i
            waiting += 1
        i = int(np.searchsorted(columns, p - RUN, "right"))
        before = 0
        while i:
            before = max(before, tree[i])
            i -= i & -i
        best[q, p] = max(before + RUN, best.get((q - 1, p - 1), -1) + 1)
    return max(best.values(), default=0)


def least_shared(length: int) -> int:
    """Places of shingles that a leaked passage of so many words shares at least."""
    return -(-(-(-length // 2)) // RUN)


def _passages(items: DataFrame, item: str, passage: str) -> tuple[DataFrame, DataFrame]:
    """Items by the words of their passage (item, passage), and shingles of each distinct passage (passage, gram, places,
    words, least). A passage is its words, joined by blanks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([" ".join(words(t)) for t in batch.column(1).to_pylist()])], names=["item", "passage"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for passage in batch.column(0).to_pylist():
                own = passage.split(" ")
                found, places = np.unique(grams(own), return_counts=True)
                n = len(found)
                yield pa.record_batch([pa.array([passage] * n, pa.string()), pa.array(found), pa.array(places.astype(np.int32)), pa.array([len(own)] * n, pa.int32()), pa.array([least_shared(len(own))] * n, pa.int32())], names=["passage", "gram", "places", "words", "least"])

    rows = items.select(F.col(item).cast("bigint").alias("item"), F.col(passage).alias("passage")).filter(F.col("item").isNotNull() & F.col("passage").isNotNull())
    named = settle(rows.mapInArrow(read, "item bigint, passage string"))
    distinct = named.filter(F.size(F.split("passage", " ")) >= RUN).select("passage").distinct()
    return named, settle(distinct.mapInArrow(shingles, "passage string, gram bigint, places int, words int, least int"))


def _stretches(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Begin and end of the stretches of words that shingles at these places cover."""
    breaks = np.flatnonzero(np.diff(places) > RUN) + 1
    return [(int(p[0]), min(int(p[-1]) + RUN, length)) for p in np.split(places, breaks) if len(p)]


def _covered(passage: str, begins: list[int], stretches: list[str]) -> int:
    """Words of the passage that the best chain of runs in the stretches holds; 0 where too few places are shared."""
    own = passage.split(" ")
    at: dict[tuple[str, ...], list[int]] = {}
    for q in range(len(own) - RUN + 1):
        at.setdefault(tuple(own[q : q + RUN]), []).append(q)
    points, shared = [], set()
    for begin, stretch in zip(begins, stretches, strict=True):
        run = stretch.split(" ")
        for p in range(len(run) - RUN + 1):
            for q in at.get(tuple(run[p : p + RUN]), ()):
                points.append((q, begin + p))
                shared.add(q)
    return chain(points) if len(shared) >= least_shared(len(own)) else 0


def leaks(docs: DataFrame, ident: str, text: str, items: DataFrame, item: str, passage: str) -> DataFrame:
    """item, doc, covered (words of the passage found in runs), item_words, for every passage and text that holds half of it."""
    spark = docs.sparkSession
    kind = docs.schema[ident].dataType.simpleString()
    named, of_passages = _passages(items, item, passage)
    every = spark.sparkContext.broadcast(Filter.of(of_passages.select("gram"), "gram"))
    texts = docs.select(F.col(ident).alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") > 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = every.value
        for batch in batches:
            met = [np.unique(g[own.holds(g)]) for t in batch.column(0).to_pylist() if len(g := grams(words(t)))]
            yield pa.record_batch([pa.array(np.concatenate(met) if met else np.zeros(0, np.int64))], names=["gram"])

    met = texts.select("text").mapInArrow(count, "gram bigint").groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    by_rarity = W.partitionBy("passage").orderBy(F.col("texts").desc(), F.col("gram").desc())
    ranked = of_passages.join(met, "gram").withColumn("dropped", F.sum("places").over(by_rarity))
    prefix = settle(ranked.filter("dropped >= least").select("passage", "gram", "words"))
    rare = spark.sparkContext.broadcast(Filter.of(prefix.select("gram"), "gram"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, all_of = rare.value, every.value
        for batch in batches:
            rows, lengths, hits, begins, runs = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = words(t)
                found = grams(own)
                first = found[some.holds(found)]
                if not len(first):
                    continue
                parts = _stretches(np.flatnonzero(all_of.holds(found)), len(own))
                rows.append(i)
                lengths.append(len(own))
                hits.append(np.unique(first))
                begins.append([a for a, _ in parts])
                runs.append([" ".join(own[a:b]) for a, b in parts])
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int32()), pa.array(hits, pa.list_(pa.int64())), pa.array(begins, pa.list_(pa.int32())), pa.array(runs, pa.list_(pa.string()))], names=["doc", "length", "hits", "begins", "stretches"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("passage", "begins", "stretches"))
            covered = [_covered(*row) for row in zip(*columns, strict=True)]
            yield pa.record_batch([batch.column("doc"), batch.column("passage"), pa.array(covered, pa.int32())], names=["doc", "passage", "covered"])

    hits = settle(texts.mapInArrow(meet, f"doc {kind}, length int, hits array<bigint>, begins array<int>, stretches array<string>").withColumn("row", F.monotonically_increasing_id()))
    met = hits.select("row", "length", F.explode("hits").alias("gram"))
    candidates = met.join(prefix, "gram").filter("length * 2 >= words").select("row", "passage").distinct()
    pairs = candidates.join(hits.select("row", "doc", "begins", "stretches"), "row").select("doc", "passage", "begins", "stretches")
    covered = pairs.mapInArrow(verify, f"doc {kind}, passage string, covered int")
    found = covered.withColumn("item_words", F.size(F.split("passage", " "))).filter("covered > 0 and covered * 2 >= item_words")
    most = found.groupBy("doc", "passage", "item_words").agg(F.max("covered").alias("covered"))
    return most.join(named, "passage").groupBy("item", "doc").agg(F.max("covered").alias("covered"), F.max_by("item_words", "covered").alias("item_words"))
