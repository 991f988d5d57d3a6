"""Reading level of each document (problem 8).

The prose of a text is set apart from its furniture line by line: menus, lists and titles fall away by their form,
notices, footers and messages by their wording, and lines broken inside a sentence are put together again. The wording is
learned from the corpus: lines that stand on several pages of different content are furniture, each as often as it has
such pages, graded samples are prose, and a line's words and word pairs are weighed by how much likelier they are in the
first than in the second.

From the prose come syntax and vocabulary features, among them soft steps at quantiles of the samples and their products,
so that a linear scorer can follow bands that both must agree on. A linear ranker learns from pairs of graded samples
of different bands, by logistic loss on the differences of their features; isotonic regression turns its scores into
levels, level between two steps where no sample lies. A document's band is that of its level. Only where the level lies
between two bands, so that the samples do not decide, an exact check follows: the stated bounds on words a sentence and
on the share of long words.

Ranker and wording are fitted on the driver: on at most ``SAMPLES`` graded samples, and on all repeated lines of all
documents. Documents are read once more, without a shuffle.

Defined results: a null, empty or blank text, one with fewer than ``LEAST_WORDS`` words of prose, without blanks between
words or without letters has no row. Repeated rows come out as often as they go in; copies of a page make none of its
lines furniture. Samples of no known band or without prose are left out; with samples of fewer than two bands the
exact check alone decides. Without repeated lines only form tells furniture. Other columns take no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Graded samples that are fitted at most.
SAMPLES = 10_000
#: Pages of different content that a line of furniture stands on.
REPEATED = 5
#: Mean weight of a line's words from which it is furniture.
FURNITURE = 0.2
#: Words of prose that a document needs.
LEAST_WORDS = 40
#: Soft steps a feature, and their width against the feature's deviation.
STEPS, WIDTH = 8, 0.2
#: How far from a band a level may lie and still be that band's.
SURE = 0.02
#: The bands, and their bounds on words a sentence and on the share of words of more than six letters.
BANDS = ("basic", "middle", "advanced")
BASIC_WORDS, BASIC_LONG, ADVANCED_WORDS, ADVANCED_LONG, LONG_LETTERS = 11, 0.15, 16, 0.35, 6

_TAG = re.compile(r"</?[a-zA-Z][\w:-]*(?:\s[^<>\n]*)?/?>|<!--.*?-->")
_LINES = re.compile("\r\n|[\n\r\v\f\u2028\u2029]")
_QUOTE = re.compile(r"^(?:>\s?)+")
_BAR = re.compile(r"\s[|>›·•»]\s")
_BULLET = re.compile(r"[*•·\-–]\s")
_ENTRY = re.compile(r"\d[.,]\d\d$|\d:\s\S{1,4}\.$")
_END = re.compile(r"[.!?]+(?=\s|$)")
_CLOSED = re.compile(r"[.!?][\"'”’»)\]]*$")
_NOT_LETTER = re.compile(r"[^\w\s]+|[\d_]+")
_LOST = re.compile("\ufffd+|[?]{2,}")
_WORD = re.compile(r"[^\W\d_]+")
_UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uff66-\uff9f]")


def _running(line: str) -> bool:
    """Whether the line reads like a part of running prose: mostly lower-case words."""
    parts = line.split()
    lower = sum(p[0].islower() for p in parts)
    return lower >= 2 and lower * 2 >= len(parts)


def _dash(token: str) -> bool:
    """Whether a token is a dash or what a wrong charset made of one."""
    return len(token) <= 4 and not token.isalnum() and not any(c.isascii() and c.isalnum() for c in token)


def _grams(line: str) -> set[str]:
    words = _WORD.findall(line.lower())
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


class Wording:
    """Weights of words and word pairs: how much likelier in lines of furniture than in sentences of prose."""

    def __init__(self, furniture: list[str], prose: list[str], pages: list[int] | None = None) -> None:
        """pages: on how many pages each line of furniture stands, and so how often it counts; once without them."""
        pages = pages or [1] * len(furniture)
        there, here = Counter(), Counter(g for line in prose for g in _grams(line))
        for line, n in zip(furniture, pages, strict=True):
            there.update(dict.fromkeys(_grams(line), n))
        prior = math.log((len(prose) + 1) / (sum(pages) + 1))
        self.weights = {g: prior + math.log((there[g] + 0.5) / (here[g] + 0.5)) for g in there | here} if furniture else {}

    def furniture(self, line: str) -> bool:
        """Whether the line's words weigh enough on average; words that were never seen weigh nothing."""
        grams = _grams(line)
        return sum(self.weights.get(g, 0.0) for g in grams) > FURNITURE * len(grams)


def _form(line: str) -> bool:
    """Whether a line has the form of a menu, a list entry or a title."""
    if _BULLET.match(line) or line.startswith(">>>"):
        return True
    parts = line.split(None, 9)
    if len(_BAR.findall(line)) * 20 > len(line.split()):
        return True
    return len(parts) < 9 and bool(_ENTRY.search(line) or len(parts) > 1 and not _CLOSED.search(line) and (parts[0][-1] == ":" or _dash(parts[1])))


def paragraphs(text: str, wording: Wording | None = None) -> list[str]:
    """The paragraphs of a text that are prose of its own."""
    if "<" in text:
        text = _TAG.sub("", text)
    blocks: list[list[str]] = []
    open_line = ""
    for raw in _LINES.split(text):
        line = raw.strip()
        quoted = line.startswith(">")
        if quoted and not line.startswith(">>>"):
            line = _QUOTE.sub("", line)
        if not line or _form(line) or wording and wording.furniture(line):
            open_line = ""
            continue
        first = next((c for c in line if c.isalnum()), "")
        alone = first.isupper() and len(line.split()) < 3 and not _CLOSED.search(line)
        if open_line and not alone and (first.islower() or len(blocks[-1]) > 1 or len(open_line) > 30) and _running(open_line):
            blocks[-1].append(line)
        else:
            blocks.append([line])
        open_line = "" if _CLOSED.search(line) else line
    out = []
    for block in blocks:
        joined = " ".join(block)
        if not joined.isascii() and len(_UNSPACED.findall(joined)) * 3 > len(joined):
            continue
        if sum(map(len, _LOST.findall(joined))) * 3 > len(joined):
            continue
        if _END.search(joined) or len(joined.split()) >= 8 and _running(joined):
            out.append(joined)
    return out


def measure(prose: list[str]) -> tuple[int, int, int, int, int]:
    """Words, sentences, long words, letters and commas of some paragraphs."""
    n = sentences = long = letters = commas = 0
    for paragraph in prose:
        commas += paragraph.count(",")
        for sentence in _END.split(paragraph):
            lengths = [len(w) for w in _NOT_LETTER.sub("", sentence).split()]
            if lengths:
                n += len(lengths)
                sentences += 1
                long += sum(x > LONG_LETTERS for x in lengths)
                letters += sum(lengths)
    return n, sentences, long, letters, commas


def features(measures: np.ndarray) -> np.ndarray:
    """Words a sentence (logarithm), share of long words, letters a word, commas a sentence."""
    n, sentences, long, letters, commas = measures.astype(float).T
    n, sentences = np.maximum(n, 1), np.maximum(sentences, 1)
    return np.column_stack([np.log(n / sentences), long / n, letters / n, commas / sentences])


def rule(measures: np.ndarray) -> np.ndarray:
    """The exact check: the number of the band by the stated bounds, compared in whole numbers."""
    n, sentences, long = measures[:, 0], np.maximum(measures[:, 1], 1), measures[:, 2]
    basic = (n < BASIC_WORDS * sentences) & (long * 100 < round(BASIC_LONG * 100) * n)
    advanced = (n > ADVANCED_WORDS * sentences) & (long * 100 > round(ADVANCED_LONG * 100) * n)
    return np.where(basic, 0, np.where(advanced, 2, 1))


def isotonic(scores: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best rising steps through the levels: lower ends of the steps, upper ends, and their heights."""
    order = np.argsort(scores, kind="stable")
    steps: list[list[float]] = []
    for score, level in zip(scores[order], levels[order], strict=True):
        steps.append([float(score), float(score), float(level), 1.0])
        while len(steps) > 1 and steps[-2][2] >= steps[-1][2]:
            _, high, level_b, weight_b = steps.pop()
            low, _, level_a, weight_a = steps.pop()
            steps.append([low, high, (level_a * weight_a + level_b * weight_b) / (weight_a + weight_b), weight_a + weight_b])
    return tuple(np.array([s[i] for s in steps]) for i in range(3))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Ranker:
    """A linear scorer learned from pairs, with the steps that turn scores into levels."""

    def __init__(self, x: np.ndarray, bands: np.ndarray, pairs: int = 200_000, penalty: float = 1e-2, rounds: int = 30) -> None:
        self.fitted = len(set(bands.tolist())) > 1
        if not self.fitted:
            self.low, self.high, self.height = np.array([0.0]), np.array([0.0]), np.array([1.0])
            return
        self.knots = np.quantile(x[:, :2], (np.arange(STEPS) + 0.5) / STEPS, axis=0)
        self.width = np.maximum(WIDTH * x[:, :2].std(0), 1e-9)
        z = self._spread(x)
        self.mean, self.scale = z.mean(0), np.maximum(z.std(0), 1e-9)
        z = (z - self.mean) / self.scale
        self.weights = np.zeros(z.shape[1])
        i, j = np.nonzero(bands[:, None] > bands[None, :]) if len(x) <= 500 else self._some(bands, pairs)
        d = z[i] - z[j]
        for _ in range(rounds):  # Newton steps on the logistic loss of the differences
            p = _logistic(d @ self.weights)
            gradient = d.T @ (p - 1) / len(d) + penalty * self.weights
            curvature = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(self.weights))
            step = np.linalg.solve(curvature, gradient)
            self.weights -= step
            if np.abs(step).max() < 1e-8:
                break
        self.low, self.high, self.height = isotonic(z @ self.weights, bands)

    def _spread(self, x: np.ndarray) -> np.ndarray:
        """The features, soft steps of the first two, and the products of these."""
        a, b = (_logistic((x[:, [i]] - self.knots[:, i]) / self.width[i]) for i in (0, 1))
        return np.column_stack([x, a, b, (a[:, :, None] * b[:, None, :]).reshape(len(x), -1)])

    @staticmethod
    def _some(bands: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different bands among so many drawn at random."""
        draw = np.random.default_rng(0)
        i, j = draw.integers(0, len(bands), (2, pairs))
        keep = bands[i] > bands[j]
        return i[keep], j[keep]

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((self._spread(x) - self.mean) / self.scale) @ self.weights if self.fitted else np.zeros(len(x))

    def level(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, np.column_stack([self.low, self.high]).ravel(), np.repeat(self.height, 2))

    def decides(self, levels: np.ndarray) -> np.ndarray:
        """Whether a level is that of a band, rather than one between two."""
        return (np.abs(levels - np.rint(levels)) <= SURE) & self.fitted


def _graded(samples: DataFrame, text: str, band: str, most: int) -> list:
    return samples.select(F.col(text).alias("text"), F.col(band).alias("band")).filter(F.col("band").isin(*BANDS) & F.col("text").isNotNull()).orderBy(F.xxhash64("text"), "text").limit(most).collect()


def fit(samples: DataFrame, text: str, band: str, most: int = SAMPLES) -> Ranker:
    """A ranker from at most ``most`` graded samples."""
    measured = [(m, BANDS.index(r["band"])) for r in _graded(samples, text, band, most) if (m := measure(paragraphs(r["text"])))[0]]
    return Ranker(features(np.array([m for m, _ in measured]).reshape(-1, 5)), np.array([b for _, b in measured], int))


def _repeated(docs: DataFrame, text: str, least: int) -> list[tuple[str, int]]:
    """The lines of repeated_lines and on how many pages each stands, most first."""
    lines = docs.filter(F.col(text).isNotNull()).select(F.expr(rf"transform(split(`{text}`, r'[\n\r\x0B\f\u2028\u2029]+'), l -> lower(regexp_replace(trim(l), '[0-9]+', '0')))").alias("lines"))
    of_pages = lines.select("lines", F.expr("xxhash64(array_max(transform(lines, l -> struct(length(l), l))).l)").alias("page"))
    each = of_pages.select(F.explode(F.expr("filter(lines, l -> l != '')")).alias("line"), "page").distinct()
    often = each.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return [(r["line"], r["n"]) for r in often.orderBy(F.desc("n"), "line").collect()]


def repeated_lines(docs: DataFrame, ident: str, text: str, least: int = REPEATED) -> list[str]:
    """All lines, in lower case and with numbers as 0, that stand on ``least`` pages or more whose longest lines differ.

    Copies of a page share their longest line, so they count once, however many there are; ids make no difference.
    """
    return [line for line, _ in _repeated(docs, text, least)]


def learn_wording(docs: DataFrame, ident: str, text: str, samples: DataFrame, sample_text: str, band: str, least: int = REPEATED) -> Wording:
    """The wording of furniture from repeated lines of the documents against the sentences of graded samples."""
    prose = [s for r in _graded(samples, sample_text, band, SAMPLES) for p in _LINES.split(r["text"]) for s in _END.split(p) if s.strip()]
    found = _repeated(docs, text, least)
    return Wording([line for line, _ in found], prose, [n for _, n in found])


def levels(docs: DataFrame, ident: str, text: str, ranker: Ranker, wording: Wording | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """ident, words, sentences, long_share, score, level (0 to 2), checked (whether the exact check decided), band."""
    kind = docs.schema[ident].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, measured = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t and (m := measure(paragraphs(t, wording)))[0] >= least_words:
                    rows.append(i)
                    measured.append(m)
            if not rows:
                continue
            m = np.array(measured)
            scores = ranker.score(features(m))
            level = ranker.level(scores)
            decided = ranker.decides(level)
            band = np.where(decided, np.rint(level).astype(int), rule(m))
            yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(m[:, 0]), pa.array(m[:, 1]), pa.array(m[:, 2] / m[:, 0]), pa.array(scores), pa.array(level), pa.array(~decided), pa.array([BANDS[b] for b in band])], names=[ident, "words", "sentences", "long_share", "score", "level", "checked", "band"])

    return docs.select(ident, text).mapInArrow(read, f"`{ident}` {kind}, words bigint, sentences bigint, long_share double, score double, level double, checked boolean, band string")
