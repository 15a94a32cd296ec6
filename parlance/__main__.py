"""Commands: python -m parlance batch --refs DIR --hyps DIR [--gates FILE --suite NAME] [--out DIR] and so on.

Exit codes: 0 good, 1 a gate failed or views differ, 2 wrong input, 3 nothing to do.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.deploy import ship
from parlance.plans import evaluation
from parlance.sources import annotated, bundles, documents, gates, lines

GOOD, FAILED, WRONG, NOTHING = range(4)


def _show(df: DataFrame, out: str | None) -> None:
    if out:
        df.write.mode("overwrite").json(out)
    else:
        df.show(50, truncate=False)


def batch(spark: SparkSession, a: argparse.Namespace) -> int:
    """Scores of all pairs below two folders; ``score`` is the same of one pair."""
    reader = bundles.documents_of if a.bundles else documents.read
    scores, status = evaluation.evaluate(spark, a.refs, a.hyps, a.meeting_schema, a.hypothesis_schema, reader=reader)
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    _show(status, a.out and f"{a.out}/status")
    if counts.get("refused") or (counts.get("missing") and a.missing == "fail"):
        return WRONG
    if not counts.get("scored"):
        return NOTHING
    scores = scores.persist()
    _show(evaluation.long(scores).orderBy("meeting_id", "metric"), a.out and f"{a.out}/scores")
    _show(evaluation.macro(scores).orderBy("metric"), a.out and f"{a.out}/macro")
    _show(evaluation.micro(scores).orderBy("metric"), a.out and f"{a.out}/micro")
    if not a.gates:
        return GOOD
    averages = {"macro": evaluation.macro, "micro": evaluation.micro}
    chosen = averages if a.gate_on == "both" else {k: v for k, v in averages.items() if k == a.gate_on}
    checks, good = gates.read(spark, a.gates, a.suite), True
    tables = {name: evaluation.reports.gates(checks, average(scores)) for name, average in chosen.items()}
    if a.gate_on == "each":
        tables["each"] = evaluation.gated_each(scores, checks)
    for name, found in tables.items():
        _show(found, a.out and f"{a.out}/gates-{name}")
        good &= found.where("not passed").isEmpty()
    return GOOD if good else FAILED


def suites(spark: SparkSession, a: argparse.Namespace) -> int:
    """The checks of a file of gates."""
    _show(gates.read(spark, a.path).orderBy("suite", "metric"), a.out)
    return GOOD


def selfcheck(spark: SparkSession, a: argparse.Namespace) -> int:
    """Scores references against themselves: every rate must be 0."""
    refs = documents.good(documents.meetings(documents.read(spark, a.path), a.meeting_schema))
    both = documents.segments(refs, "R").unionByName(documents.segments(refs, "H"))
    rates = [m for _, m in evaluation.HEADLINE] + ["speaker_count.abs_error"]
    off = evaluation.long(evaluation.flat(both)).where(F.col("metric").isin(rates) & (F.abs("value") > 1e-9))
    _show(off, a.out)
    return NOTHING if refs.isEmpty() else GOOD if off.isEmpty() else FAILED


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    docs = documents.read(spark, a.path)
    found = documents.hypotheses(docs, a.hypothesis_schema) if a.hypotheses else documents.meetings(docs, a.meeting_schema)
    bad = found.where("size(errors) > 0").select("path", "errors")
    _show(bad, a.out)
    return NOTHING if docs.isEmpty() else GOOD if bad.isEmpty() else WRONG


def stats(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = lines.rttm(lines.read_lines(spark, a.path))
    _show(lines.statistics(rows.where("error is null")), a.out)
    return GOOD if rows.where("error is not null").isEmpty() else WRONG


def crosscheck(spark: SparkSession, a: argparse.Namespace) -> int:
    """Turns of one folder of RTTM files that another lacks, with their number."""
    one, two = (lines.rttm(lines.read_lines(spark, p)).where("error is null").select("meeting_id", "label", "lo", "hi") for p in (a.path, a.other))
    only = one.exceptAll(two).withColumn("side", F.lit("first")).unionByName(two.exceptAll(one).withColumn("side", F.lit("second")))
    _show(only.groupBy("side", "meeting_id").count(), a.out)
    return GOOD if only.isEmpty() else FAILED


def import_stm(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = lines.stm(lines.read_lines(spark, a.path), nist=True)
    if not rows.where("error is not null").isEmpty():
        _show(rows.where("error is not null"), None)
        return WRONG
    segments, meetings = lines.stm_meetings(rows)
    _show(segments, a.out and f"{a.out}/segments")
    _show(meetings, a.out and f"{a.out}/meetings")
    return NOTHING if segments.isEmpty() else GOOD


def convert(spark: SparkSession, a: argparse.Namespace) -> int:
    """Word files of an annotated corpus (meeting.label.words.xml) to turns as RTTM and STM."""
    found = annotated.tokens(documents.read(spark, a.path, "*.xml"))
    if not found.where("error is not null").isEmpty():
        _show(found.where("error is not null"), None)
        return WRONG
    durations = spark.read.schema("meeting_id string, duration double").json(a.durations)
    turns = annotated.speaker_turns(annotated.repaired(annotated.of_speakers(found, durations)), a.truncated == "keep").persist()
    lines.write(lines.rttm_lines(turns), f"{a.out}/rttm")
    lines.write(lines.stm_lines(turns), f"{a.out}/stm")
    return NOTHING if turns.isEmpty() else GOOD


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="parlance", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple[str, dict]) -> None:
        c = commands.add_parser(name, help=run.__doc__)
        c.set_defaults(run=run)
        for flag, how in (*options, ("--out", {}), ("--meeting-schema", {"default": "meeting/1"}), ("--hypothesis-schema", {"default": "hypothesis/1"})):
            c.add_argument(flag, **how)

    pair = (("--refs", {"required": True}), ("--hyps", {"required": True}), ("--gates", {}), ("--suite", {}), ("--gate-on", {"default": "macro", "choices": ["macro", "micro", "both", "each"]}), ("--missing", {"default": "fail", "choices": ["fail", "skip"]}), ("--bundles", {"action": "store_true"}))
    command("score", batch, *pair)
    command("batch", batch, *pair)
    command("validate", validate, ("path", {}), ("--hypotheses", {"action": "store_true"}))
    command("suites", suites, ("path", {}))
    command("selfcheck", selfcheck, ("path", {}))
    command("stats", stats, ("path", {}))
    command("crosscheck", crosscheck, ("path", {}), ("other", {}))
    command("import-stm", import_stm, ("path", {}))
    command("convert", convert, ("path", {}), ("--durations", {"required": True}), ("--truncated", {"default": "keep", "choices": ["keep", "drop"]}))
    return top


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("parlance").getOrCreate()
    ship(spark)
    try:
        return a.run(spark, a)
    except (ValueError, PySparkException) as wrong:
        print(f"{a.command}: {wrong}", file=sys.stderr)
        return WRONG


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
