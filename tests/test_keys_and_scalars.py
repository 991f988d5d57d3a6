import math

import pytest
from pyspark.sql import functions as F

from wardline.functions import scalars
from wardline.functions.keys import user_key

KEYS = {
    "2033119f9146771e1820f8cc": "2033119f9146771e1820f8cc", " 0XAB12 ": "ab12", '"0x0de5"': "0de5", "uid=753E": "753e", "acct=59af": "59af", "sha/08d4": "08d4", "U_fcca": "fcca",
    "{923f-e0}": "923fe0", "30e25c\r\n": "30e25c", "c385 ddd2": "c385ddd2", "\xa0e285": "e285", "'ccbc\n'": "ccbc", "id:0x12": "0x12", "": None, "  ": None, "--": None, None: None, "[user:AB": "ab", "uid=": None,
}


def test_keys(spark):
    got = spark.createDataFrame([(k,) for k in KEYS], "raw string").select("raw", user_key("raw").alias("key")).collect()
    assert {r.raw: r.key for r in got} == KEYS


NUMBERS = {" 1.5 ": 1.5, "": None, "nan": None, "NaN": None, "abc": None, "inf": math.inf, "-Infinity": -math.inf, "1e3": 1000.0, "1_0": None, "1d": None, "0x1p3": None, ".5": 0.5, "5.": 5.0, "+2": 2.0, None: None, "1\n": 1.0}


def test_safe_float(spark):
    got = spark.createDataFrame([(k,) for k in NUMBERS], "t string").select("t", scalars.safe_float(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == NUMBERS


def test_clip_and_flags(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (0.5,), (50.0,)], "x double")
    x = F.col("x")
    got = df.select(scalars.between(x, 0, 1), scalars.flag(x > 0), scalars.sigmoid(x, 20.0), scalars.signed_log1p(x), scalars.ratio(x, F.lit(0.0))).collect()
    assert tuple(got[0]) == (None, 0, None, None, None)
    assert got[1][0] == 0.0 and got[3][0] == 1.0 and got[3][2] == pytest.approx(1 / (1 + math.exp(-20)))
    assert got[1][3] == pytest.approx(-math.log(6)) and got[2][4] is None
