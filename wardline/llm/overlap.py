"""Same or near-same records across splits (problem 1).

A sparse suffix array over the concatenated texts of both splits. At most two slips leave one of a train text's three
thirds unbroken, and in the test text it starts at most two places away. So the array holds, of train texts, the
suffixes that begin a third, and of test texts those that begin where such a third can have come to stand. Suffixes are
ordered by a range partitioning on sampled quantiles and a sort within partitions; suffixes of thirds of one length
form a stretch of the array. Neighbours whose common prefix is a third or longer make a run; runs that cross into the
next partition are carried over and put together. Cross-split pairs of a run share a span, the common prefix with what
precedes it in both; pairs are verified there and then, and the spans of a pair are merged into its coverage.

A run of more than ``run_cap`` suffixes, which only texts of little variety have, gives no pairs, as pairs of a run grow
with its square. Its texts, and train texts of at most ``SHORT`` characters, go another exact way: texts at most two
slips apart have a string in common among those left after dropping at most two characters, and are joined on it. A
bucket there holds texts at most four slips apart, so the work follows the result. Their coverage is measured alike.

Coverage is the share of the test text's characters in spans: longest stretches that both texts share, as far apart as
two slips can bring them, that hold a whole third (one character at least) of the train text. It is never null.

Defined results: null and empty texts match nothing. Texts equal in both splits match at distance 0 with coverage 1.
Every row counts for itself. An empty split matches nothing. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import settle, shuffle_width

#: Slips that a match may have.
SLIPS = 2
#: Train texts up to this length are joined on what is left after dropping characters.
SHORT = 8
#: Runs of more suffixes than this are joined the other way.
RUN_CAP = 1024

_OUT = "kind int, train_text string, test_text string, begin int, until int, length int, suffix string, head string, in_test int"
_SCHEMA = pa.schema([("kind", pa.int32()), ("train_text", pa.string()), ("test_text", pa.string()), ("begin", pa.int32()), ("until", pa.int32()), ("length", pa.int32()), ("suffix", pa.string()), ("head", pa.string()), ("in_test", pa.int32())])
#: Kinds of rows that come out of the array: a pair's span, a suffix of a run that may go on, a text of a crowded run.
PAIR, OPEN, CROWDED = 0, 1, 2


def _texts(train: DataFrame, test: DataFrame, text: str) -> DataFrame:
    side = lambda df, a, b: df.select(F.col(text).alias("text"), F.lit(a).alias("in_train"), F.lit(b).alias("in_test"))
    both = side(train, 1, 0).unionByName(side(test, 0, 1)).filter("length(text) > 0")
    return both.groupBy("text").agg(F.max("in_train").alias("in_train"), F.max("in_test").alias("in_test"))


def _of_train(m: int) -> list[tuple[int, int]]:
    """Length and beginning of the thirds of a train text of m characters."""
    return [(m // (SLIPS + 1), i * m // (SLIPS + 1)) for i in range(SLIPS + 1)] if m > SHORT else []


def _of_test(n: int) -> list[tuple[int, int]]:
    """Length of, and where there can stand in a test text of n characters, the thirds of train texts of any length.

    Slips left of a third move it by s places at least, slips right of it make up for the rest of the difference.
    """
    apart = range(-SLIPS, SLIPS + 1)
    return sorted({(size, at + s) for d in apart for size, at in _of_train(n + d) for s in apart if abs(s) + abs(s + d) <= SLIPS and 0 <= at + s <= n - size})


def _suffixes(texts: DataFrame) -> DataFrame:
    """The suffixes that the array holds: length (of the third), suffix, head (what precedes it), in_test."""
    lengths = [r["n"] for r in texts.select(F.length("text").alias("n")).distinct().collect()]
    places = [(n, flag, [{"length": size, "at": at} for size, at in of(n)]) for n in lengths for flag, of in ((0, _of_train), (1, _of_test))]
    # a row for every length that a text has, with no more places than slips allow
    known = texts.sparkSession.createDataFrame(places, "n int, in_test int, places array<struct<length: int, at: int>>")
    sides = texts.select("text", F.length("text").alias("n"), F.explode(F.expr("filter(array(if(in_train = 1, 0, null), if(in_test = 1, 1, null)), x -> x is not null)")).alias("in_test"))
    rows = sides.join(F.broadcast(known), ["n", "in_test"]).select("text", "in_test", F.explode("places").alias("p"))
    return rows.select("p.length", F.expr("substring(text, p.at + 1)").alias("suffix"), F.expr("substring(text, 1, p.at)").alias("head"), "in_test")


def slips(a: str, b: str) -> int:
    """The edit distance of two texts, SLIPS + 1 for any greater one."""
    over = SLIPS + 1
    if abs(len(a) - len(b)) > SLIPS:
        return over
    at, most = 0, min(len(a), len(b))
    while at < most and a[at] == b[at]:
        at += 1
    m, n = len(a), len(b)
    while m > at and n > at and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[at:m], b[at:n]
    # furthest[k]: characters of a that so many slips can get through with b k places ahead
    furthest = {0: 0}
    for done in range(over):
        reached = {}
        for k, x in furthest.items():
            while x < len(a) and x + k < len(b) and a[x] == b[x + k]:
                x += 1
            if x >= len(a) and x + k >= len(b):
                return done
            for to, y in ((k, x + 1), (k - 1, x + 1), (k + 1, x)):
                if y <= len(a) and y + to <= len(b) and y > reached.get(to, -1):
                    reached[to] = y
        furthest = reached
    return over


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def span(train_head: str, train_suffix: str, test_head: str, test_suffix: str) -> tuple[int, int]:
    """Begin and end, in the test text, of the stretch that both share around the places where their suffixes begin."""
    return len(test_head) - _common(train_head[::-1], test_head[::-1]), len(test_head) + _common(train_suffix, test_suffix)


def _spans(a: str, b: str) -> set[tuple[int, int]]:
    """All spans of a pair, from the texts alone."""
    size, out = max(1, len(a) // (SLIPS + 1)), set()
    for i in range(SLIPS + 1):
        p = min(i * len(a) // (SLIPS + 1), len(a) - 1)
        for q in range(max(p - SLIPS, 0), min(p + SLIPS, len(b) - 1) + 1):
            if abs(q - p) + abs(q - p + len(a) - len(b)) <= SLIPS and a[p : p + size] == b[q : q + size]:
                out.add(span(a[:p], a[p:], b[:q], b[q:]))
    return out


def _pairs(run: list[tuple]) -> list[tuple]:
    """The spans of the run's cross-split pairs that are at most two slips apart: train, test, begin, until."""
    train, test = [r for r in run if not r[3]], [r for r in run if r[3]]
    if not train or not test:
        return []
    sizes = [np.array([[len(r[2]), -len(r[1])] for r in side]) for side in (train, test)]
    near = np.abs(sizes[0][:, None] - sizes[1][None]).sum(2) <= SLIPS  # slips before the suffixes and in them
    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        (_, s, h, _), (_, s2, h2, _) = train[i], test[j]
        if slips(h + s, h2 + s2) <= SLIPS:
            out.append((h + s, h2 + s2, *span(h, s, h2, s2)))
    return out


def _array(run_cap: int, carry: bool):
    """Reads one sorted partition of the array. With carry its first and last run, which may go on in the partitions
    beside it, come out as they are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the run being read, up to run_cap + 1 of it
        key: tuple | None = None
        crowded, first = False, True
        out: list[tuple] = []

        def close(last: bool) -> None:
            nonlocal first
            if carry and (first or last):
                out.extend((OPEN, None, None, None, None, *r) for r in held)
            elif not crowded and len(held) > 1:
                out.extend((PAIR, *p, None, None, None, None) for p in _pairs(held))
            first = False

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            out.clear()
            return batch

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            length, suffix = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            prefix = np.empty(size, object)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                prefix[at] = pc.utf8_slice_codeunits(suffix.take(pa.array(at)), 0, int(n)).to_numpy(zero_copy_only=False)
            starts = np.ones(size, bool)
            starts[1:] = (length[1:] != length[:-1]) | (prefix[1:] != prefix[:-1])
            begins = np.flatnonzero(starts)
            ends = np.append(begins[1:], size)
            # a suffix alone in its run, with others before and after it in the batch, meets nobody
            worth = (ends - begins > 1) | (begins == 0) | (ends == size)
            for b, e in zip(begins[worth], ends[worth], strict=True):
                own = (int(length[b]), prefix[b])
                if own != key:
                    if key is not None:
                        close(False)
                    held, key, crowded = [], own, False
                rows = list(zip(*(batch.column(i).slice(b, e - b).to_pylist() for i in range(4)), strict=True))
                if not crowded and len(held) + len(rows) > run_cap:
                    crowded = True
                    out.extend((CROWDED, *((None, r[2] + r[1]) if r[3] else (r[2] + r[1], None)), None, None, None, None, None, None) for r in held)
                if crowded:
                    out.extend((CROWDED, *((None, r[2] + r[1]) if r[3] else (r[2] + r[1], None)), None, None, None, None, None, None) for r in rows)
                held += rows[: run_cap + 1 - len(held)]
                if len(out) > 4096:
                    yield flush()
        if key is not None:
            close(True)
        if out:
            yield flush()

    return read


def _variants(texts: DataFrame, name: str) -> DataFrame:
    """What is left of each text after dropping at most two characters: variant, name."""
    left = """flatten(transform(sequence(0, length(text)), i -> transform(sequence(i, length(text)), j -> CASE
        WHEN j = 0 THEN text
        WHEN i = 0 OR i = j THEN concat(substring(text, 1, j - 1), substring(text, j + 1))
        ELSE concat(substring(text, 1, i - 1), substring(text, i + 1, j - i - 1), substring(text, j + 1)) END)))"""
    return texts.select(F.col("text").alias(name), F.explode(F.expr(f"array_distinct(transform({left}, v -> xxhash64(v)))")).alias("variant"))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(a, b, *s) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in _spans(a, b) or [(0, 0)]]
        yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["train_text", "test_text", "begin", "until"])


def matches(train: DataFrame, test: DataFrame, text: str = "text", run_cap: int = RUN_CAP) -> DataFrame:
    """Distinct pairs train_text, test_text at most two slips apart, with distance and coverage."""
    texts = settle(_texts(train, test, text))
    ordered = _suffixes(texts).repartitionByRange(shuffle_width(texts.sparkSession), "length", "suffix", "head").sortWithinPartitions("length", "suffix")
    inner = settle(ordered.mapInArrow(_array(run_cap, True), _OUT))
    # suffixes of runs at the partitions' ends: no more than two runs a partition, of run_cap + 1 suffixes each
    carried = inner.filter(f"kind = {OPEN}").select("length", "suffix", "head", "in_test").repartition("length", F.expr("substring(suffix, 1, length)")).sortWithinPartitions("length", "suffix")
    whole = inner.filter(f"kind != {OPEN}").unionByName(settle(carried.mapInArrow(_array(run_cap, False), _OUT)))
    of_runs = whole.filter(f"kind = {PAIR}").select("train_text", "test_text", "begin", "until")
    crowd = lambda name: whole.filter(f"kind = {CROWDED}").select(F.col(name).alias("text")).filter("text is not null")
    rest = lambda name, split, short: crowd(name).unionByName(texts.filter(f"{split} = 1 and length(text) <= {short}").select("text")).distinct()
    dropped = _variants(rest("train_text", "in_train", SHORT), "train_text").join(_variants(rest("test_text", "in_test", SHORT + SLIPS), "test_text"), "variant").select("train_text", "test_text").distinct()
    near = dropped.filter(F.levenshtein("train_text", "test_text", SLIPS) >= 0)
    of_rest = near.mapInArrow(_measured, "train_text string, test_text string, begin int, until int")
    spans = of_runs.unionByName(of_rest).groupBy("train_text", "test_text").agg(F.collect_set(F.struct("begin", "until")).alias("spans"))
    covered = F.expr("size(array_distinct(flatten(transform(filter(spans, s -> s.until > s.begin), s -> sequence(s.begin, s.until - 1)))))")
    return spans.select("train_text", "test_text", F.levenshtein("train_text", "test_text").alias("distance"), (covered / F.length("test_text")).alias("coverage"))


def row_pairs(found: DataFrame, train: DataFrame, test: DataFrame, text: str, ident: str) -> DataFrame:
    """Every pair of rows whose texts match: train_<ident>, test_<ident>, distance, coverage."""
    a = train.select(F.col(text).alias("train_text"), F.col(ident).alias(f"train_{ident}"))
    b = test.select(F.col(text).alias("test_text"), F.col(ident).alias(f"test_{ident}"))
    return found.join(a, "train_text").join(b, "test_text").select(f"train_{ident}", f"test_{ident}", "distance", "coverage")


def overlap_counts(found: DataFrame, train: DataFrame, test: DataFrame, text: str, by_train: list[str], by_test: list[str]) -> DataFrame:
    """Matching row pairs by the given columns, from counts per text; no pair of rows is made."""
    a = train.groupBy(F.col(text).alias("train_text"), *[F.col(c).alias(f"train_{c}") for c in by_train]).agg(F.count(F.lit(1)).alias("_a"))
    b = test.groupBy(F.col(text).alias("test_text"), *[F.col(c).alias(f"test_{c}") for c in by_test]).agg(F.count(F.lit(1)).alias("_b"))
    rows = found.join(a, "train_text").join(b, "test_text")
    by = [*[f"test_{c}" for c in by_test], *[f"train_{c}" for c in by_train]]
    return rows.groupBy(*by).agg(F.sum(F.col("_a") * F.col("_b")).alias("pairs"), F.sum(F.when(F.col("distance") == 0, F.col("_a") * F.col("_b")).otherwise(0)).alias("exact_pairs"))
