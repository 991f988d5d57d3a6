import random

import pytest

from wardline.llm import leak

RNG = random.Random(11)
VOCAB = [f"w{i}" for i in range(400)]


def passage(n):
    return [RNG.choice(VOCAB) for _ in range(n)]


def cover(a, b):
    """Most words of a in runs of at least eight that stand in b, in order; plain dynamic programming."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    run = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            run[i][j] = run[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else 0
            best[i][j] = max(best[i - 1][j], best[i][j - 1])
            for n in range(8, run[i][j] + 1):
                best[i][j] = max(best[i][j], best[i - n][j - n] + n)
    return best[-1][-1]


def cases():
    items = [(i, passage(RNG.randrange(8, 60))) for i in range(12)] + [(90, passage(7)), (91, None), (92, [])]
    items.append((93, items[0][1]))
    docs = []
    for d in range(60):
        words = passage(RNG.randrange(0, 30))
        for _ in range(RNG.randrange(1, 3)):
            _, source = RNG.choice(items[:12])
            at = 0
            while at < len(source):
                n = RNG.choice([3, 7, 8, 9, 15, 25])
                words += source[at : at + n] if RNG.random() < 0.7 else []
                words += passage(RNG.randrange(0, 4))
                at += n
        docs.append((d, words))
    return items, docs


@pytest.mark.parametrize("bits", [leak.FILTER_BITS, 64])
def test_equals_brute_force(spark, monkeypatch, bits):
    """Also with a map of so few bits that it thins out nothing."""
    monkeypatch.setattr(leak, "FILTER_BITS", bits)
    items, docs = cases()
    written = lambda w: None if w is None else " ".join(w)
    texts = [(d, written(w), "x") for d, w in docs] + [(900, None, "x"), (901, "", "x"), (0, written(docs[0][1]), "again")]
    table = spark.createDataFrame(texts, "doc_id bigint, text string, item string")
    of = spark.createDataFrame([(i, written(w), "y") for i, w in items], "item_id bigint, passage string, doc string")
    got = leak.leaks(table, "doc_id", "text", of, "item_id", "passage").collect()
    have = {(r.item, r.doc): r.covered for r in got}
    assert len(have) == len(got)
    want = {(i, d): c for i, w in items if w for d, t in docs if 2 * (c := cover(w, t)) >= len(w) and c}
    assert have == want and len(want) > 10


def test_writing_makes_no_difference():
    plain = "the quick brown foxes don't jump over lazy counterdogs"
    for other in ("The QUICK, brown — foxes don’t jump\nover lazy counter­dogs!", "the <b>qui</b>ck  brown\tfoxes&nbsp;don't jump over lazy counter-\ndogs", "> the quick brown foxes\n> don't jump over lazy counterdogs", "ｔｈｅ quick brówn fo​xes do'nt jump over lazy counterdogs"):
        assert leak.words(other) == leak.words(plain), other


def test_long_tags_are_markup():
    plain = "the quick brown foxes jump over lazy dogs"
    for inside in ('hidden data-state="' + "many words " * 40 + '"', 'style="' + "color: red; " * 30 + '"', 'src="data:image/png;base64,' + "iVBORw0KGgo" * 500 + '"'):
        assert leak.words(f"the quick brown <div {inside}>foxes jump</div> over lazy dogs") == plain.split(), inside[:20]
    unclosed = "the quick brown <foxes jump over lazy dogs " + "and more " * 40
    assert leak.words(unclosed) == unclosed.replace("<", "").split()
    assert leak.words(unclosed + "<b>end</b>") == unclosed.replace("<", "").split() + ["end"]
    assert leak.words(unclosed + "\n> and a quote") == unclosed.replace("<", "").split() + ["and", "a", "quote"]


def test_passes_do_not_grow_with_passages(spark):
    """Ten times the passages: as many scans of the texts, and one map of the same size."""
    docs = spark.createDataFrame([(1, " ".join(VOCAB[:50]))], "doc_id bigint, text string")
    many = spark.createDataFrame([(i, " ".join(VOCAB[i : i + 20])) for i in range(300)], "item_id bigint, passage string")
    scans = []
    for n in (30, 300):
        read = spark.sparkContext.accumulator(0)

        def seen(batches, read=read):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        assert leak.leaks(docs.mapInArrow(seen, docs.schema), "doc_id", "text", many.filter(f"item_id < {n}"), "item_id", "passage").count() == min(n, 41)
        scans.append(read.value)
    assert scans == [2, 2]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, passage string")
    assert leak.leaks(docs, "doc_id", "text", none, "item_id", "passage").count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id bigint, passage string")
    assert leak.leaks(docs.limit(0), "doc_id", "text", some, "item_id", "passage").count() == 0
    assert leak.leaks(docs, "doc_id", "text", some, "item_id", "passage").count() == 1
