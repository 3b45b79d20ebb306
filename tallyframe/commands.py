"""Commands for spark-submit: each a job with declared inputs and outputs that takes up its finished steps.

    spark-submit --py-files tallyframe.zip tallyframe/__main__.py score-oof --oof oof.csv --work work --output scores
    python -m tallyframe self-training-round --round 1 ...

Tables are CSV files with a header (by the ending .csv) or Parquet. --work is a folder that all executors share; it keeps
what steps made, so that a command that was killed goes on where it stopped.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import LABELS
from .jobs import Job
from .operators import corrections as C
from .operators import metrics, rules, splits, tables
from .sources import commits, readers, writers
from .steps import cleared, delete

ID = "StudyInstanceUID"
#: Fixed value: predictions of no more variance than this are taken for collapsed.
LEAST_VARIANCE = 0.01


class Refused(RuntimeError):
    """What a command found that its caller must see: a leak, missing columns, collapsed predictions."""


def table(spark: SparkSession, path: str) -> DataFrame:
    """A table in the order of its file, with a column _ord."""
    name = path.rstrip("/").lower()
    return readers.ordered(readers.csv(spark, path) if name.endswith((".csv", ".csv.gz")) else spark.read.parquet(path))


def store(df: DataFrame, path: str) -> None:
    """df at a path, in place of what was there, in the format of its ending."""
    writers.write_csv(df, path) if path.rstrip("/").lower().endswith(".csv") else df.write.mode("overwrite").parquet(path)


def in_order(df: DataFrame) -> DataFrame:
    """df in the order of _ord, without it: sorted by ranges when it is written."""
    return df.orderBy("_ord").drop("_ord")


def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def build_splits(spark: SparkSession, a: argparse.Namespace) -> None:
    job = Job(spark, a.work, "build-splits", {"train": a.train}, folds=a.folds, seed=a.seed, columns=[a.study_col, a.patient_col, a.site_col, a.language_col])
    train = tables.require(table(spark, a.train), [a.study_col])
    folds = job.step("folds", lambda: splits.cv_splits(train, a.folds, a.seed, a.study_col, a.patient_col, a.site_col, a.language_col).select(a.study_col, "fold", "_ord"))

    def leaking() -> dict:
        if a.patient_col not in train.columns:
            return {"patients": 0}
        return {"patients": splits.group_leaks(folds, train, a.study_col, a.patient_col).count()}

    leaks = job.effect("leaks", leaking)["patients"]
    job.effect("output", lambda: store(in_order(folds), a.output) or {"path": a.output})
    print(f"wrote splits: {a.output}")
    print(f"patients in several folds: {leaks or 'none'}")
    if leaks:
        raise Refused(f"{leaks} patients are in several folds")


def _print_scores(per_label: list, macro: float | None) -> None:
    print(f"macro_auc={macro:.6f}" if macro is not None else "macro_auc=none")
    for r in per_label:
        if r.auc is not None:
            print(f"{r.label}={r.auc:.6f}")


def _logged(job: Job, a: argparse.Namespace, split: str, macro: float | None, per_label: dict[str, float], notes: str) -> None:
    """A row of the run log, once for a run of these inputs under a name."""
    if not a.tracker:
        return
    row = writers.run_row(job.spark, run_id=a.run_id, split=split, model=a.model_name, macro_auc=macro, public_lb_auc=a.public_lb_auc, train_minutes=a.train_minutes, cost_usd=a.cost_usd, per_label_auc=per_label, notes=notes)
    commits.commit(row, a.tracker, f"{a.run_id}-{job.mark}")
    print(f"logged in: {a.tracker}")


def score_oof(spark: SparkSession, a: argparse.Namespace) -> None:
    job = Job(spark, a.work, "score-oof", {"oof": a.oof}, labels=a.labels, id=a.study_col)
    scores = lambda: readers.oof(table(spark, a.oof), a.labels, a.study_col, truncate=True)
    aucs = job.step("aucs", lambda: metrics.auc_by(scores(), ["label"]))
    if a.output:
        job.effect("output", lambda: store(aucs, a.output) or {"path": a.output})
    per_label = aucs.orderBy("label").collect()  # a row for each label
    macro = metrics.macro(aucs).first().macro_auc
    _print_scores(per_label, macro)
    _logged(job, a, a.split_name, macro, {r.label: r.auc for r in per_label if r.auc is not None}, a.notes)


def make_submission(spark: SparkSession, a: argparse.Namespace) -> None:
    job = Job(spark, a.work, "make-submission", {"ids": a.ids, "predictions": a.predictions}, labels=a.labels, id=a.study_col)

    def rows() -> DataFrame:
        ids = tables.require(table(spark, a.ids), [a.study_col]).select(F.col(a.study_col).alias("id"), "_ord")
        found = tables.require(table(spark, a.predictions), [a.study_col, *a.labels])
        last = tables.keep_last(found.select(F.col(a.study_col).alias("id"), "_ord", *_quoted(a.labels)), ["id"], ["_ord"]).drop("_ord")
        return tables.strict_left(ids, last, "id", a.labels).withColumnRenamed("id", a.study_col)

    told = job.step("rows", rows)
    job.effect("output", lambda: store(in_order(told), a.output) or {"path": a.output})
    print(f"wrote submission: {a.output}")


def extract_labels(spark: SparkSession, a: argparse.Namespace) -> None:
    job = Job(spark, a.work, "extract-labels", {"train": a.train, "cache": a.cache if a.engine != "rules" else None}, labels=a.labels, engine=a.engine, only_gold=a.only_gold, limit=a.limit, model=a.model, version=a.prompt_version, columns=[a.study_col, a.report_col])

    def reports() -> DataFrame:
        every = tables.require(table(spark, a.train), [a.study_col, a.report_col, *(a.labels if a.only_gold else [])])
        if a.only_gold:
            gold = [readers.number(F.col(f"`{x}`")) for x in a.labels]
            every = every.where(reduce(lambda x, y: x & y, [g.isNotNull() for g in gold]))
        every = every.select(F.col(a.study_col).cast("string").alias("id"), F.col(a.report_col).alias("report"), "_ord")
        if a.limit:  # the first reports, as asked for
            every = every.orderBy("_ord").limit(a.limit)
        return tables.keep_last(every, ["id"], ["_ord"])

    own = job.step("reports", reports)
    by_rules = job.step("rules", lambda: rules.extract(own, labels=tuple(a.labels)))
    language = by_rules.groupBy("id").agg(F.first("language").alias("language"))
    if a.engine == "rules":
        merged = by_rules.select("id", "label", "status", "score", F.lit("rules").alias("engine"))
    else:
        model = job.step("model", lambda: _from_cache(spark, a, own))
        whole = F.col("error") == ""
        if a.engine == "model":  # a report whose result is an error has its rules' labels
            merged = tables.merged(by_rules, model)
        else:
            merged = tables.merged(by_rules, model)
            audit = job.step("audit", lambda: tables.audit(by_rules, model))
            if a.audit and job.effect("audit-output", lambda: {"written": writers.write_if_any(audit.orderBy("place").drop("place"), a.audit)})["written"]:
                print(f"wrote {audit.count()} disagreements: {a.audit}")
        language = model.where(whole).groupBy("id").agg(F.first("language").alias("model_language")).join(language, "id", "right").select("id", F.coalesce("model_language", "language").alias("language"))

    def wide() -> DataFrame:
        # a report has one engine: the model's where it gave all its labels
        engine = merged.groupBy("id").agg(F.min("engine").alias("engine"))
        long = merged.drop("engine").join(engine, "id").join(language, "id")
        return writers.pseudo_labels(long, a.labels).join(own.select("id", "_ord"), "id").withColumnRenamed("id", a.study_col)

    told = job.step("labels", wide)
    job.effect("output", lambda: store(in_order(told), a.output) or {"path": a.output})
    print(f"wrote {told.count()} rows: {a.output}")
    for r in told.groupBy("language").count().orderBy(F.col("count").desc(), "language").limit(12).collect():
        print(f"{r.language}: {r['count']}")


def _from_cache(spark: SparkSession, a: argparse.Namespace, own: DataFrame) -> DataFrame:
    """(id, language, label, status, score, error) of the cached results of reports: JSON files named by their ids."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(a.cache)
    stem = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    cache = files.select(stem.alias("id"), F.decode("content", "UTF-8").alias("value")).join(own.select("id"), "id", "left_semi")
    return readers.decoded(readers.cached_results(cache, a.model, a.prompt_version)).where("label is not null")


def eval_extraction(spark: SparkSession, a: argparse.Namespace) -> None:
    job = Job(spark, a.work, "eval-extraction", {"pseudo": a.pseudo, "train": a.train}, labels=a.labels, threshold=a.threshold, id=a.study_col)

    def told() -> DataFrame:
        gold = readers.gold_rows(table(spark, a.train), a.labels, a.study_col)
        pseudo = tables.require(table(spark, a.pseudo), [a.study_col, *a.labels])
        last = tables.keep_last(pseudo.select(F.col(a.study_col).cast("string").alias("id"), "_ord", *_quoted(a.labels)), ["id"], ["_ord"])
        y = tables.to_long(gold, "id", a.labels, "y").withColumn("y", F.col("y").cast("int"))
        return metrics.evaluated(y, tables.to_long(last, "id", a.labels, "p"), a.threshold)

    result = job.step("scores", told)
    if a.output:
        job.effect("output", lambda: store(result, a.output) or {"path": a.output})
    rows = {r.label: r for r in result.collect()}  # a row for each label
    macro = next((r.macro_auc for r in rows.values()), None)
    for x in a.labels:
        r = rows.get(x)
        auc = f"{r.auc:.4f}" if r and r.auc is not None else "n/a (one class)"
        print(f"{x:<18} n={r.n if r else 0:<6} acc={r.accuracy if r else float('nan'):.3f} auc={auc}")
    print(f"macro_auc={macro:.4f}" if macro is not None else "macro_auc=none")
    _logged(job, a, "gold", macro, {x: r.auc for x, r in rows.items() if r.auc is not None}, f"acc@{a.threshold}")


def gold_split(spark: SparkSession, a: argparse.Namespace) -> None:
    if not a.overwrite and commits.read_text(spark, a.output) is not None:
        raise Refused(f"{a.output} is there already; a split is made once")
    job = Job(spark, a.work, "gold-split", {"train": a.train}, labels=a.labels, seed=a.seed, locked=a.locked_size, id=a.study_col)
    gold = job.step("gold", lambda: readers.gold_rows(table(spark, a.train), a.labels, a.study_col))
    slices = job.step("slices", lambda: splits.stratified_split(gold, a.labels, a.locked_size, a.seed))
    positives = tables.to_long(gold, "id", a.labels, "y").withColumn("y", F.coalesce(F.col("y") >= 0.5, F.lit(False)).cast("int"))
    payload = writers.split_payload(slices, positives, a.seed).select(F.to_json(F.struct("*")).alias("j")).first().j
    if a.overwrite:
        delete(spark, a.output)
    if not commits.create(spark, a.output, payload):
        raise Refused(f"{a.output} is there already; a split is made once")
    for r in slices.groupBy("slice").count().orderBy("slice").collect():
        print(f"{r.slice}: {r['count']}")
    print(f"wrote split: {a.output}")


def self_training_round(spark: SparkSession, a: argparse.Namespace) -> None:
    inputs = {"teacher": a.teacher_oof, "labels": a.labels_table, "train": a.train, "split": a.split, "weights": a.label_weights}
    job = Job(spark, a.work, "self-training-round", inputs, labels=a.labels, round=a.round, most=a.max_corrections, id=a.study_col)
    given = tables.require(table(spark, a.labels_table), [a.study_col, *a.labels]).withColumn(a.study_col, F.col(a.study_col).cast("string"))

    def rows() -> DataFrame:
        teacher = readers.teacher(table(spark, a.teacher_oof), a.labels, a.study_col)
        last = tables.keep_last(given.select(F.col(a.study_col).alias("id"), "_ord", *_quoted(a.labels)), ["id"], ["_ord"])
        return tables.to_long(last, "id", a.labels, "cur").join(teacher, ["id", "label"], "left").select("id", "label", "cur", "p")

    gold = job.step("gold", lambda: readers.gold_rows(table(spark, a.train), a.labels, a.study_col))
    own = job.step("rows", rows)

    def weights() -> DataFrame:
        names = spark.createDataFrame([(x,) for x in a.labels], "label string")
        if not a.label_weights:
            return names.withColumn("w", F.lit(0.5))
        return readers.label_weights(spark.read.option("wholetext", True).text(a.label_weights), names)

    trusted = job.step("weights", weights)
    # only the working slice says which labels have few gold positives, but no gold row is ever corrected
    working = readers.split_json(spark, a.split).where("slice = 'working'").select("id")
    gold_long = tables.to_long(gold, "id", a.labels, "cur")
    reports = ("labels", "counts", "thresholds", "joint", "drift")
    with cleared(spark):  # all reports come from the same corrections, which are made only if one is missing
        result = None if {*reports} <= {*job.finished()} else C.run_corrections(own, trusted, gold.select("id"), C.pair_table(spark), a.max_corrections or None, identity=a.max_corrections == 0, positives=C.positive_counts(gold_long, working))
        told = {k: job.step(k, lambda k=k: result[k]) for k in reports}
    labels_path, report_path = f"{a.output}/labels_r{a.round}.csv", f"{a.output}/corrections_report.json"
    job.effect("labels-output", lambda: store(in_order(writers.restored(told, given, a.labels, a.study_col)), labels_path) or {"path": labels_path})

    def report() -> dict:
        text = writers.corrections_report(told).first().report
        whole = f'{{"round": {a.round}, "teacher_oof": {_json(a.teacher_oof)}, "labels_in": {_json(a.labels_table)}, "labels_out": {_json(labels_path)}, "max_corrections": {_json(a.max_corrections)}, {text[1:]}'
        delete(spark, report_path)
        commits.create(spark, report_path, whole)
        return {"path": report_path}

    job.effect("report", report)
    for r in writers.summary(told["counts"]).orderBy("label").collect():  # a row for each label
        print(r.line)
    print(f"wrote {labels_path}")
    if a.triage:
        checked = metrics.collapsed(readers.teacher(table(spark, a.triage), a.labels, a.study_col), LEAST_VARIANCE).first()
        print(f"triage: largest variance {checked.max_variance:.5f}")
        if not checked.passes:
            raise Refused(f"predictions have a variance of {checked.max_variance:.5f}, {LEAST_VARIANCE} at most: collapsed")


def _json(value) -> str:
    import json

    return json.dumps(value)


COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], None]] = {
    "build-splits": build_splits,
    "score-oof": score_oof,
    "make-submission": make_submission,
    "extract-labels": extract_labels,
    "eval-extraction": eval_extraction,
    "gold-split": gold_split,
    "self-training-round": self_training_round,
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyframe", description=__doc__.splitlines()[0])
    every = argparse.ArgumentParser(add_help=False)
    every.add_argument("--work", required=True, help="folder of finished steps, shared by all executors")
    every.add_argument("--study-col", default=ID)
    every.add_argument("--labels", type=lambda s: s.split(","), default=list(LABELS), help="label columns, comma-separated")
    log = argparse.ArgumentParser(add_help=False)
    log.add_argument("--tracker", help="folder of the run log")
    log.add_argument("--run-id", default="manual-run")
    log.add_argument("--model-name", default="model")
    for name in ("--public-lb-auc", "--train-minutes", "--cost-usd"):
        log.add_argument(name, type=float)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *parents: argparse.ArgumentParser, **paths: bool) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text, parents=[every, *parents])
        for path, required in paths.items():
            p.add_argument("--" + path.replace("_", "-"), required=required)
        return p

    p = command("build-splits", "folds by groups of studies", train=True, output=True)
    p.add_argument("--folds", type=int, default=5)
    p.add_argument("--seed", type=int, default=2026)
    p.add_argument("--patient-col", default="PatientID")
    p.add_argument("--site-col", default="SiteID")
    p.add_argument("--language-col", default="Language")
    p = command("score-oof", "AUC of out-of-fold predictions", log, oof=True, output=False)
    p.add_argument("--split-name", default="cv")
    p.add_argument("--notes", default="")
    command("make-submission", "predictions of given ids", ids=True, predictions=True, output=True)
    p = command("extract-labels", "labels of reports", train=True, output=True, cache=False, audit=False)
    p.add_argument("--engine", choices=["rules", "model", "merged"], default="rules")
    p.add_argument("--report-col", default="Report")
    p.add_argument("--model", default="model")
    p.add_argument("--prompt-version", type=int, default=1)
    p.add_argument("--only-gold", action="store_true")
    p.add_argument("--limit", type=int, help="the first reports only")
    p = command("eval-extraction", "extracted labels against gold ones", log, pseudo=True, train=True, output=False)
    p.add_argument("--threshold", type=float, default=0.5)
    p = command("gold-split", "working and locked gold rows, once", train=True, output=True)
    p.add_argument("--seed", type=int, default=2026)
    p.add_argument("--locked-size", type=int, default=20)
    p.add_argument("--overwrite", action="store_true")
    p = command("self-training-round", "correct labels by a teacher's predictions", teacher_oof=True, labels_table=True, train=True, split=True, label_weights=False, output=True, triage=False)
    p.add_argument("--round", type=int, required=True)
    p.add_argument("--max-corrections", type=int, help="of each label; 0 changes nothing")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "extract-labels" and a.engine != "rules" and not a.cache:
        raise SystemExit("--cache is needed for this engine")
    own = spark or SparkSession.builder.appName(f"tallyframe {a.command}").getOrCreate()
    try:
        COMMANDS[a.command](own, a)
    except Refused as e:
        print(f"refused: {e}")
        return 2
    except (FileNotFoundError, ValueError) as e:
        print(f"error: {e}")
        return 1
    finally:
        if spark is None:
            own.stop()
    return 0
