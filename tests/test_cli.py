import random

from wardline import cli
from wardline.operators import people
from wardline.sources import files


def write(path, header, rows):
    path.write_text("\n".join([header, *[",".join("" if v is None else str(v) for v in r) for r in rows]]) + "\n")


def test_score_and_validate(spark, tmp_path, capsys):
    rng = random.Random(1)
    user = lambda i: f"{i:024x}"
    rows = []
    for i in range(160):
        y = int(i % 4 == 0)
        rows.append((user(i), round(rng.gauss(3 * y, 1), 3), rng.choice([None, 1, 2]), None if i % 10 == 9 else y, 1 if i % 20 == 19 else None))
    write(tmp_path / "train.csv", "user_hash,feature_001,feature_002,is_cheating,high_conf_clean", rows)
    write(tmp_path / "test.csv", "user_hash,feature_001,feature_002", [(user(1000 + i), round(rng.gauss(3 * (i % 2), 1), 3), None) for i in range(30)])
    write(tmp_path / "g.csv", "user_a,user_b", [(user(i), user(1000 + i % 30)) for i in range(100)])
    for learner, extra in (("linear", []), ("logistic", ["--graph", str(tmp_path / "g.csv"), "--eval", "--folds", "2"])):
        out = str(tmp_path / learner)
        assert cli.main(["--train", str(tmp_path / "train.csv"), "--test", str(tmp_path / "test.csv"), "--out", out, "--learner", learner, *extra]) == 0
        assert cli.main(["--test", str(tmp_path / "test.csv"), "--validate", out]) == 0
        scores = {r.user_hash: float(r.prediction) for r in files.read_text(spark, out).collect()}
        assert len(scores) == 30 and scores[user(1001)] > scores[user(1000)]
    assert "AUC" in capsys.readouterr().out
    write(tmp_path / "bad.csv", "user_hash,prediction", [(user(1000), 2.0)])
    assert cli.main(["--test", str(tmp_path / "test.csv"), "--validate", str(tmp_path / "bad.csv")]) == 1


def test_bad_files_are_told(spark, tmp_path):
    (tmp_path / "test.csv").write_text("user_hash,feature_001\na,1\nb,2\n")
    (tmp_path / "short.csv").write_text("user_hash,prediction\na,0.5\nb\n")
    (tmp_path / "named.csv").write_text("user,prediction\na,0.5\nb,0.5\n")
    (tmp_path / "good.csv").write_text("user_hash,prediction\na,0.5\nb,0.25\n")
    told = lambda name: {r.violation for r in files.malformed(spark, str(tmp_path / name)).collect()}
    assert told("short.csv") == {"short row"} and told("named.csv") == {"bad header"} and told("good.csv") == set()
    for name, wrong in (("short.csv", 1), ("named.csv", 1), ("good.csv", 0)):
        assert cli.main(["--test", str(tmp_path / "test.csv"), "--validate", str(tmp_path / name)]) == wrong


def test_repeated_rows_and_conflicting_labels(spark, tmp_path):
    """The last row of a user gives its label, and equal rows stay single rows."""
    (tmp_path / "train.csv").write_text("user_hash,feature_001,is_cheating,high_conf_clean\na,1,0,\na,1,1,\nb,2,1,\nb,2,1,\nb,2,0,\n")
    train = cli.numbered(people.cleaned(files.read_users(spark, str(tmp_path / "train.csv"))))
    assert train.select("row_id").distinct().count() == 5
    assert {r.key: r.y for r in people.user_labels(train).collect()} == {"a": 1, "b": 0}
