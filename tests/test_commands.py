"""Commands on small files: each ends, gives the same when it runs again, and goes on after it was killed."""

import csv
import glob
import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tallyframe import commands
from tallyframe.functions.text import LABELS
from tallyframe.jobs import Job
from tallyframe.sources import commits
from tallyframe.steps import exists

ID = commands.ID


def put(path, columns, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([columns, *rows])
    return str(path)


def rows_of(path):
    """The rows of a CSV folder in the order of its files."""
    out = []
    for part in sorted(glob.glob(f"{path}/part-*")):
        with open(part, newline="", encoding="utf-8") as f:
            out += list(csv.DictReader(f))
    return out


def run(spark, capsys, *argv):
    code = commands.main([str(a) for a in argv], spark)
    return code, capsys.readouterr().out


def test_splits(spark, tmp_path, capsys):
    train = put(tmp_path / "train.csv", [ID, "PatientID", "SiteID", "Language"], [(f"s{i}", f"p{i // 3}" if i % 7 else "", i % 2, "en") for i in range(60)])
    args = ["build-splits", "--train", train, "--output", tmp_path / "folds.csv", "--work", tmp_path / "work", "--folds", 4]
    code, out = run(spark, capsys, *args)
    folds = rows_of(tmp_path / "folds.csv")
    assert [r[ID] for r in folds] == [f"s{i}" for i in range(60)] and {r["fold"] for r in folds} == set("0123") and list(folds[0]) == [ID, "fold"]
    # sites part a patient's studies, so some leak, and the command says so
    assert ("refused" in out) == (code == 2) and code in (0, 2)
    assert run(spark, capsys, *args)[0] == code and rows_of(tmp_path / "folds.csv") == folds
    code, out = run(spark, capsys, *args[:4], tmp_path / "folds2.csv", "--work", tmp_path / "work2", "--site-col", "none")
    assert code == 0 and "none" in out


def oof_file(tmp_path, name="oof.csv"):
    rng = random.Random(3)
    columns = [ID, *[f"{x}{s}" for x in LABELS for s in ("_true", "_pred")]]
    return put(tmp_path / name, columns, [(f"s{i}", *[v for k in range(len(LABELS)) for v in (float((i + k) % 3 == 0), round(rng.random() * 0.6 + 0.4 * ((i + k) % 3 == 0), 3))]) for i in range(40)])


def test_scores_are_logged_once(spark, tmp_path, capsys):
    args = ["score-oof", "--oof", oof_file(tmp_path), "--work", tmp_path / "work", "--tracker", tmp_path / "runs", "--run-id", "r1", "--train-minutes", 2.5, "--output", tmp_path / "aucs"]
    outs = [run(spark, capsys, *args)[1] for _ in range(2)]
    assert outs[0] == outs[1] and outs[0].startswith("macro_auc=0.") and "Fracture=" in outs[0]
    logged = commits.everything(spark, str(tmp_path / "runs")).collect()
    assert len(logged) == 1 and logged[0].run_id == "r1" and logged[0].train_minutes == "2.50" and len(json.loads(logged[0].per_label_auc)) == len(LABELS)
    assert spark.read.parquet(str(tmp_path / "aucs")).count() == len(LABELS)
    run(spark, capsys, *args[:-5], "r2")
    assert len(commits.keys(spark, str(tmp_path / "runs"))) == 2


def test_submission(spark, tmp_path, capsys):
    ids = put(tmp_path / "ids.csv", [ID], [("b",), ("a",), ("b",)])
    preds = put(tmp_path / "preds.csv", ["extra", ID, "A", "B"], [("x", "a", "0.10", 1), ("x", "b", 0.3, 0), ("x", "c", 9, 9), ("x", "b", 0.4, 0.5)])
    base = ["make-submission", "--labels", "A,B", "--ids", ids, "--work", tmp_path / "work"]
    assert run(spark, capsys, *base, "--predictions", preds, "--output", tmp_path / "sub.csv")[0] == 0
    assert [tuple(r.values()) for r in rows_of(tmp_path / "sub.csv")] == [("b", "0.4", "0.5"), ("a", "0.10", "1"), ("b", "0.4", "0.5")]
    lacking = put(tmp_path / "few.csv", [ID, "A", "B"], [("a", 1, 1)])
    with pytest.raises(Exception, match="no prediction for b"):
        run(spark, capsys, *base, "--predictions", lacking, "--output", tmp_path / "sub2.csv")
    assert not os.path.exists(tmp_path / "sub2.csv")
    code, out = run(spark, capsys, *base[:-2], "--work", tmp_path / "w2", "--predictions", tmp_path / "gone.csv", "--output", tmp_path / "x.csv")
    assert code == 1 and "gone.csv" in out
    code, out = run(spark, capsys, *base, "--predictions", put(tmp_path / "no.csv", [ID, "A"], [("a", 1)]), "--output", tmp_path / "x.csv")
    assert code == 1 and "missing columns: ['B']" in out


REPORTS = [("1", "Findings: complete tear of the ACL.", 1), ("2", "Findings: the ACL is intact. Impression: no tear of the ACL.", 0), ("3", "Findings: joint effusion.", ""), ("4", "", 0)]


def test_extraction_and_evaluation(spark, tmp_path, capsys):
    train = put(tmp_path / "train.csv", [ID, "Report", "ACL", "Effusion"], [(i, r, y, y) for i, r, y in REPORTS])
    own = ["--labels", "ACL,Effusion", "--work", tmp_path / "work"]
    code, out = run(spark, capsys, "extract-labels", "--train", train, "--output", tmp_path / "rules.csv", *own)
    rules = {r[ID]: r for r in rows_of(tmp_path / "rules.csv")}
    assert code == 0 and "wrote 4 rows" in out and list(rules) == ["1", "2", "3", "4"]
    assert (float(rules["1"]["ACL"]), float(rules["2"]["ACL"]), float(rules["3"]["Effusion"])) == (0.9, 0.05, 0.9) and rules["1"]["engine"] == "rules"
    cache = tmp_path / "cache"
    cache.mkdir()
    response = lambda a, e: {"model": "m", "prompt_version": 3, "response": {"language": "en", "labels": {"ACL": {"status": a, "evidence": "x"}, "Effusion": {"status": e, "evidence": ""}}}, "error": ""}
    (cache / "1.json").write_text(json.dumps(response("uncertain", "affirmed")))
    (cache / "2.json").write_text(json.dumps({"model": "m", "prompt_version": 3, "error": "refused"}))
    (cache / "3.json").write_text("{")
    code, out = run(spark, capsys, "extract-labels", "--train", train, "--output", tmp_path / "merged.csv", "--engine", "merged", "--cache", cache, "--model", "m", "--prompt-version", 3, "--audit", tmp_path / "audit.csv", *own)
    merged = {r[ID]: r for r in rows_of(tmp_path / "merged.csv")}
    assert code == 0 and (float(merged["1"]["ACL"]), merged["1"]["engine"], merged["1"]["language"]) == (0.6, "model", "en")
    assert {i: merged[i]["ACL"] for i in "234"} == {i: rules[i]["ACL"] for i in "234"} and merged["2"]["engine"] == "rules"
    assert {(r["id"], r["label"], r["model_status"]) for r in rows_of(tmp_path / "audit.csv")} == {("1", "ACL", "uncertain"), ("1", "Effusion", "affirmed")}
    code, out = run(spark, capsys, "extract-labels", "--train", train, "--output", tmp_path / "gold.csv", "--only-gold", "--limit", 2, *own)
    assert [r[ID] for r in rows_of(tmp_path / "gold.csv")] == ["1", "2"]
    code, out = run(spark, capsys, "eval-extraction", "--pseudo", tmp_path / "rules.csv", "--train", train, "--tracker", tmp_path / "runs", *own)
    assert code == 0 and "n=3" in out and "auc=1.0000" in out.splitlines()[0]
    assert commits.everything(spark, str(tmp_path / "runs")).first().split == "gold"
    with pytest.raises(SystemExit):
        run(spark, capsys, "extract-labels", "--train", train, "--output", tmp_path / "x.csv", "--engine", "model", *own)


def round_files(tmp_path, n=120):
    rng = random.Random(9)
    labels = ["ACL", "Contusion"]
    truth = {i: [int((i + 2 * k) % 4 == 0) for k in range(2)] for i in range(n)}
    given = [(f"s{i}", "keep me", *[0.9 if (y if rng.random() > 0.1 else 1 - y) else 0.1 for y in truth[i]], i * 2) for i in range(n)]
    teacher = [(f"s{i}", *[round(0.15 + 0.7 * y + rng.random() * 0.1, 4) for y in truth[i]]) for i in range(n)]
    gold = [(f"s{i}", *(truth[i] if i % 5 == 0 else ("", ""))) for i in range(n)]
    return {
        "labels": put(tmp_path / "labels.csv", [ID, "note", *labels, "tail"], given),
        "teacher": put(tmp_path / "teacher.csv", [ID, *[f"{x}_pred" for x in labels]], teacher),
        "train": put(tmp_path / "train.csv", [ID, *labels], gold),
    }, given, teacher, gold


def round_args(tmp_path, files, *more):
    return ["self-training-round", "--labels", "ACL,Contusion", "--round", 1, "--teacher-oof", files["teacher"], "--labels-table", files["labels"], "--train", files["train"], "--split", tmp_path / "split.json", "--output", tmp_path / "out", "--work", tmp_path / "work", *more]


def test_gold_split_and_round(spark, tmp_path, capsys):
    files, given, teacher, gold = round_files(tmp_path)
    split = ["gold-split", "--labels", "ACL,Contusion", "--train", files["train"], "--output", tmp_path / "split.json", "--locked-size", 8, "--work", tmp_path / "work"]
    code, out = run(spark, capsys, *split)
    told = json.loads((tmp_path / "split.json").read_text())
    assert code == 0 and len(told["locked"]) == 8 and len(told["working"]) == 16 and "locked: 8" in out
    assert run(spark, capsys, *split)[0] == 2 and json.loads((tmp_path / "split.json").read_text()) == told
    assert run(spark, capsys, *split, "--overwrite")[0] == 0 and json.loads((tmp_path / "split.json").read_text()) == told
    weights = tmp_path / "weights.json"
    weights.write_text(json.dumps({"ACL": 0.95, "Contusion": 0.9}))
    code, out = run(spark, capsys, *round_args(tmp_path, files, "--label-weights", weights))
    assert code == 0 and "labels_r1.csv" in out
    back = rows_of(tmp_path / "out" / "labels_r1.csv")
    assert list(back[0]) == [ID, "note", "ACL", "Contusion", "tail"]
    assert [(r[ID], r["note"], r["tail"]) for r in back] == [(g[0], g[1], str(g[4])) for g in given]
    flipped = 0
    for r, g, t, own in zip(back, given, teacher, gold, strict=True):
        for k, x in enumerate(("ACL", "Contusion")):
            if float(r[x]) != g[2 + k]:
                flipped += 1
                # a flip goes to the teacher's side and to a hard label, never in a gold row
                assert own[1] == "" and float(r[x]) in (0.0, 1.0) and (float(r[x]) == 1.0) == (t[1 + k] > 0.5)
    report = json.loads((tmp_path / "out" / "corrections_report.json").read_text())
    assert flipped == sum(c["accepted"] for c in report["counts"]) > 0 and report["round"] == 1
    # again: nothing is made anew, and the result stays
    assert run(spark, capsys, *round_args(tmp_path, files, "--label-weights", weights))[1] == out and rows_of(tmp_path / "out" / "labels_r1.csv") == back
    code, _ = run(spark, capsys, *round_args(tmp_path, files, "--max-corrections", 0, "--triage", files["teacher"]))
    same = rows_of(tmp_path / "out" / "labels_r1.csv")
    assert code == 0 and [[float(r[x]) for x in ("ACL", "Contusion")] for r in same] == [list(g[2:4]) for g in given]
    flat = put(tmp_path / "flat.csv", [ID, "ACL_pred", "Contusion_pred"], [(f"s{i}", 0.5, 0.5) for i in range(5)])
    code, out = run(spark, capsys, *round_args(tmp_path, files, "--max-corrections", 0, "--triage", flat))
    assert code == 2 and "collapsed" in out


def test_round_goes_on_where_it_was_killed(spark, tmp_path, capsys, monkeypatch):
    files, *_ = round_files(tmp_path, 60)
    run(spark, capsys, "gold-split", "--labels", "ACL,Contusion", "--train", files["train"], "--output", tmp_path / "split.json", "--locked-size", 4, "--work", tmp_path / "work")
    made, step = [], Job.step

    def watched(self, name, make):
        out = step(self, name, lambda: made.append(name) or make())
        if name == stop:
            raise KeyboardInterrupt
        return out

    monkeypatch.setattr(Job, "step", watched)
    for stop in ("rows", "labels"):
        with pytest.raises(KeyboardInterrupt):
            run(spark, capsys, *round_args(tmp_path, files))
    stop = None
    assert run(spark, capsys, *round_args(tmp_path, files))[0] == 0
    assert made == ["gold", "rows", "weights", "labels", "counts", "thresholds", "joint", "drift"]
    killed = rows_of(tmp_path / "out" / "labels_r1.csv")
    args = [str(a).replace(str(tmp_path / "work"), str(tmp_path / "fresh")).replace(str(tmp_path / "out"), str(tmp_path / "out2")) for a in round_args(tmp_path, files)]
    assert run(spark, capsys, *args)[0] == 0 and rows_of(tmp_path / "out2" / "labels_r1.csv") == killed
    # another input makes all anew
    made.clear()
    files["teacher"] = put(tmp_path / "teacher.csv", [ID, "ACL_pred", "Contusion_pred"], [(f"s{i}", 0.2, 0.4) for i in range(60)])
    assert run(spark, capsys, *round_args(tmp_path, files))[0] == 0 and len(made) == 8


def test_command_is_a_process(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(commands.__file__)))
    args = [sys.executable, "-m", "tallyframe", "score-oof", "--oof", oof_file(tmp_path), "--work", str(tmp_path / "work")]
    env = {**os.environ, "PYTHONPATH": root, "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run(args, env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and done.stdout.startswith("macro_auc=0."), done.stderr[-2000:]


def test_two_writers_commit_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = str(tmp_path / "shared")
    writers = [spark.range(100).select(F.lit(w).alias("writer"), F.col("id")) for w in range(4)]
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda df: {r.writer for r in commits.commit(df, folder, "k").collect()}, writers))
    assert len({frozenset(g) for g in got}) == 1 and all(len(g) == 1 for g in got)
    assert commits.everything(spark, folder).count() == 100 and commits.keys(spark, folder) == ["k"]
    # what the losers wrote is gone
    assert len([p for p in os.listdir(folder) if p.startswith("k-")]) == 1
    assert commits.committed(spark, folder, "none") is None and commits.everything(spark, str(tmp_path / "none")) is None
    assert not exists(spark, str(tmp_path / "none"))
