import json

import pytest

from wardline.sources import files


def test_csv_round_trip_and_missing(spark, tmp_path):
    (tmp_path / "train.csv").write_text('user_hash,feature_001,feature_002,is_cheating,high_conf_clean\n0012,1.5,NA,1,\n"a\nb",nan,null,,1.0\nc,x\n')
    got = files.read_users(spark, str(tmp_path / "train.csv")).collect()
    assert [(r.user_hash, r.feature_001, r.feature_002, r.is_cheating, r.high_conf_clean) for r in got] == [("0012", 1.5, None, 1.0, None), ("a\nb", None, None, None, 1.0), ("c", None, None, None, None)]
    with pytest.raises(ValueError, match="user_hash"):
        (tmp_path / "bad.csv").write_text("x\n1\n")
        files.read_users(spark, str(tmp_path / "bad.csv"))


def test_optional_links(spark, tmp_path):
    assert files.read_links(spark, None) is None and files.read_links(spark, str(tmp_path / "none.csv")) is None
    (tmp_path / "g.csv").write_text("user_a,user_b,other\n1,2,3\n")
    assert [tuple(r) for r in files.read_links(spark, str(tmp_path / "g.csv")).collect()] == [("1", "2")]


def test_metadata(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"feature_001": {"type": "numeric", "range": "1-5", "missing_%": 11.9}}, indent=1))
    assert [tuple(r) for r in files.read_metadata(spark, str(tmp_path / "m.json")).collect()] == [("feature_001", "numeric", "1-5", 11.9)]


def test_submission(spark, tmp_path):
    scores = spark.createDataFrame([("a", 0.25), ("b", 1.0)], "user_hash string, prediction double")
    files.write_submission(scores, str(tmp_path / "out"))
    back = files.read_text(spark, str(tmp_path / "out")).collect()
    assert sorted(tuple(r) for r in back) == [("a", "0.2500000000"), ("b", "1.0000000000")]
    test = scores.select("user_hash")
    assert files.violations(scores, test).count() == 0
    bad = spark.createDataFrame([("a", 0.25), ("a", 0.5), ("c", 1.2), ("d", float("nan")), (None, None)], "user_hash string, prediction double")
    got = {r.violation: (r.n, r.examples) for r in files.violations(bad, test).collect()}
    assert got == {"duplicate id": (1, "a"), "bad prediction": (3, "|c|d"), "missing id": (1, "b"), "unknown id": (3, "|c|d"), "row count": (5, "2")}
