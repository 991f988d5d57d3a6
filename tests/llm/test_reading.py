import os

import numpy as np
import pytest

from wardline.llm import reading as r

BASIC = "The dog saw my red hat. We got a new cat! Was it so big? " * 5
ADVANCED = "Whereas institutional observation necessitated contemporary remuneration throughout the surrounding administrative districts, the interpretation reported there constrained transformation considerably. " * 3
FURNITURE = "Home\nShop\nAbout us\nStedalton: compass ticket\n12.03.2024 10:11 | Stedalton\n* item one\ncrow – 384,99\nWe use cookies to improve your visit. By going on you accept our cookie policy.\n© 5 Grower Media. All rights reserved.\n404 – Page not found. The page you asked for does not exist or has moved.\n"
NOTICES = ["We use cookies to improve your visit. By going on you accept our cookie policy.", "© 0 Grower Media. All rights reserved.", "0 – Page not found. The page you asked for does not exist or has moved."]
WORDING = r.Wording([n.lower() for n in NOTICES], [s for t in (BASIC, ADVANCED) for s in t.split(". ")])


def test_prose_is_told_from_furniture():
    assert r.paragraphs(FURNITURE, WORDING) == []
    whole = r.measure(r.paragraphs(BASIC))
    assert r.measure(r.paragraphs(FURNITURE + BASIC + "\n" + FURNITURE, WORDING)) == whole
    assert whole[:2] == (75, 15)
    # other names in a known wording, and no wording at all
    assert r.paragraphs("© 99 Others Media. All rights reserved.", WORDING) == []
    # one known word among many unknown ones decides nothing
    assert len(r.paragraphs("Cookie " + " ".join(f"word{c}{d}" for c in "abcdef" for d in "xyz") + ".", WORDING)) == 1
    assert len(r.paragraphs(FURNITURE, r.Wording([], []))) == len(r.paragraphs(FURNITURE)) > 0


def test_repeated_lines_are_not_those_of_copies(spark):
    page = "This story stands on many hosts and is long enough to be the longest line of its page.\nShort prose of it."
    docs = [(i, f"Menu {i}\n{page}\nAll rights reserved, {i}.", "x") for i in range(30)]
    docs += [(100 + i, f"A page of its own, with number {'i' * (i + 50)} written out.\nAll rights reserved, {i}.", "x") for i in range(6)] + [(None, None, "x"), (7, "", "x")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, line string")
    assert r.repeated_lines(table, "doc_id", "text") == ["all rights reserved, 0."]
    assert r.repeated_lines(table.limit(0), "doc_id", "text") == []


def test_repeated_lines_are_sought_in_all_documents(spark):
    """6,000 lines on seven or eight pages each and a long one on six, among 45,000 pages: all are found, whatever the number of pages."""
    from pyspark.sql import functions as F

    letters = lambda c: F.translate(c.cast("string"), "0123456789", "abcdefghij")
    own = F.concat(F.lit("Page of its own "), letters(F.col("id")), F.when(F.col("id") < 6, F.lit("y" * 1_500)).otherwise(""))
    text = F.concat_ws("\n", own, F.concat(F.lit("Notice "), letters(F.col("id") % 6_000)), F.when(F.col("id") < 6, F.lit("x" * 1_200)))
    found = r.repeated_lines(spark.range(45_000).select("id", text.alias("text")), "id", "text")
    assert sum(line.startswith("notice ") for line in found) == 6_000 and "x" * 1_200 in found and len(found) == 6_001


def test_lines_count_once_for_each_page():
    """Prose that some pages quote does not become furniture beside a notice of a thousand pages."""
    notice, quoted, prose = "all rights reserved.", "the old lamp stood near the quiet river.", ["the old lamp stood there", "a quiet river"] * 5
    wording = r.Wording([notice, quoted], prose, [1_000, 5])
    assert wording.furniture(notice) and not wording.furniture(quoted)
    assert r.Wording([notice, quoted], prose).weights == r.Wording([notice, quoted], prose, [1, 1]).weights


def test_broken_lines_are_put_together():
    flat = "The ferry that described our famous festival also copied the teacher beside the bridge in Pellraton. Nobody watched the old lantern until Ruskragate copied it."
    broken = "The ferry that described our famous festival\nalso copied the teacher beside the bridge in\nPellraton. Nobody watched the old lantern until\nRuskragate copied it."
    assert r.measure(r.paragraphs(broken)) == r.measure(r.paragraphs(flat))


def test_levels(spark):
    samples = spark.createDataFrame([(BASIC + "We met a fox.", "basic"), (BASIC, "basic"), (ADVANCED, "advanced"), (ADVANCED + "Nevertheless, administration continued.", "advanced"), (None, "middle"), ("x", "odd")], "text string, band string")
    ranker = r.fit(samples, "text", "band")
    rows = [(1, BASIC), (2, FURNITURE + ADVANCED), (3, None), (4, ""), (5, "   "), (6, "日本語の文章です。" * 60), (7, FURNITURE), (8, "The dog saw it. " * 4), (9, "�" * 500), (10, "�������� Pellmouth ����� ��������. " * 50), (11, "?????? ???? Pellmouth ???????. " * 50), (1, BASIC), (None, BASIC)]
    docs = spark.createDataFrame([(*x, "b") for x in rows], "doc_id bigint, text string, band string")
    got = r.levels(docs, "doc_id", "text", ranker, WORDING).collect()
    assert sorted((x.doc_id or 0, x.band) for x in got) == [(0, "basic"), (1, "basic"), (1, "basic"), (2, "advanced")]
    assert not any(x.checked for x in got)
    assert r.levels(docs.limit(0), "doc_id", "text", ranker).count() == 0


def test_the_ranker_gives_the_band(spark):
    """Samples graded the other way round turn the bands over, so the rows come from the ranker and not from the bounds."""
    turned = spark.createDataFrame([(BASIC + "We met a fox.", "advanced"), (BASIC, "advanced"), (ADVANCED, "basic"), (ADVANCED + "Nevertheless, administration continued.", "basic")], "text string, band string")
    docs = spark.createDataFrame([(1, BASIC), (2, ADVANCED)], "doc_id bigint, text string")
    got = r.levels(docs, "doc_id", "text", r.fit(turned, "text", "band")).collect()
    assert sorted((x.doc_id, x.band, x.checked) for x in got) == [(1, "advanced", False), (2, "basic", False)]


def test_no_samples_leave_the_exact_check(spark):
    ranker = r.fit(spark.createDataFrame([], "text string, band string"), "text", "band")
    docs = spark.createDataFrame([(1, ADVANCED)], "doc_id bigint, text string")
    assert r.levels(docs, "doc_id", "text", ranker).first().band == "advanced"


def test_isotonic_rises():
    low, high, height = r.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([1.0, 0.0, 2.0, 2.0]))
    assert list(height) == [0.0, 1.5, 2.0] and list(low) == [1.0, 2.0, 4.0] and list(high) == [1.0, 3.0, 4.0]


GRADED = "/root/testdata/sf0.01/graded_samples.parquet"


@pytest.mark.skipif(not os.path.exists(GRADED), reason="needs the test tables")
def test_held_out_accuracy(spark):
    rows = spark.read.parquet(GRADED).select("sample_id", "text", "band").toPandas()
    held = rows.sample_id % 3 == 0
    ranker = r.fit(spark.createDataFrame(rows[~held]), "text", "band")
    measures = np.array([r.measure(r.paragraphs(t)) for t in rows[held].text])
    bands = np.array([r.BANDS.index(b) for b in rows[held].band])
    assert (np.rint(ranker.level(ranker.score(r.features(measures)))) == bands).mean() >= 0.9
    assert (r.rule(measures) == bands).all()
