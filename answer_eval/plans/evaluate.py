"""End-to-end evaluation job: requests -> graded rows -> reports.

A request (JSON or tag text) names the participants and the example limit; every
participant is graded on the first N problems (in the file's order) from the
answer log, and the report is written as JSON, text and a per-example table.

    spark-submit answer_eval/plans/evaluate.py \\
        --problems /data/problems.csv --answers /data/answer-log/ \\
        --request /data/request.txt --out /data/results/

On a cluster ``spark.checkpoint.dir`` must name a shared folder (numbering
checkpoints there).
"""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __package__ in (None, ""):  # run as a script by spark-submit
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from answer_eval.operators.grade import grade, granted, limited_rows, row_key  # noqa: E402
from answer_eval.operators.metrics import report  # noqa: E402
from answer_eval.session import configure, ensure_checkpoint_dir  # noqa: E402
from answer_eval.sinks.report import json_parts, text_parts, write_parts, write_results  # noqa: E402
from answer_eval.sources.answers import broken_counts, decode_envelope, read_answer_log, read_answers  # noqa: E402
from answer_eval.sources.problems import FILE_ORDER, coerce_labels, number_rows, number_samples, read_problems  # noqa: E402
from answer_eval.sources.requests import parse_requests  # noqa: E402


REQUEST_KEY = ["request_id", "position"]


@dataclass
class Evaluation:
    report: DataFrame      # one row per participant of a request: request_id, position, 22 report fields
    graded: DataFrame      # one row per participant x problem
    people: DataFrame      # request_id, position, participant, agent_id
    errors: DataFrame      # request error rows (empty when the requests were usable)


def evaluate(problems: DataFrame, requests: DataFrame, answers: DataFrame, key=None, order_by=None,
             mode: str = "substring", order_col: str | None = None) -> Evaluation:
    """Grade the participants named by ``requests`` (request_id, body; any number of them).

    ``problems`` needs a row key (``key``, else example_id or sample_num, see ``row_key``) and
    ``label``; ``answers`` the decoded reply columns with the same key and the
    participant: by request_id and position if it has both, else by the participant's
    name.  Problems are numbered in the order of ``order_by`` (default: the file's order
    where the table has it, else the key), and every request's limit is an interval of
    those numbers (``limited_rows``): missing or 0 = all, N > 0 = first N, N < 0 = all but the last |N|.
    Pairs beyond a limit are never made.
    Participants are told apart by request and position, so equal names stay apart.  A
    request without participants yields no report rows and its error row.
    ``order_col`` picks the first of several replies to one row; without it a second
    reply fails the job.

    Replies that belong to names are graded once for each name, as far as its longest limit, and kept
    (a checkpoint of narrow rows); every request of the name then takes the graded rows of its interval.
    """
    participants, errors = parse_requests(requests)
    people = participants.select(*REQUEST_KEY, F.col("name").alias("participant"), "agent_id", "max_examples")
    if order_by is None:
        order_by = FILE_ORDER if set(FILE_ORDER) <= set(problems.columns) else row_key(key, problems)
    given = [c for c in dict.fromkeys(["story_id", *row_key(key, answers)]) if c in problems.columns]
    numbered, total = number_rows(
        coerce_labels(problems, order_by=order_by).select(*given, *[c for c in order_by if c not in given], "expected"),
        list(order_by))
    gold = numbered.select(*given, "sample_num", "expected")
    asked, names = people.drop("agent_id"), ["participant"]
    if set(REQUEST_KEY) <= set(answers.columns):
        expected = limited_rows(gold, asked, total).drop("max_examples")
        graded = grade(expected, answers, key=key, participant_col=REQUEST_KEY, mode=mode, order_col=order_col)
    else:
        longest = asked.groupBy(*names).agg(F.max(granted("max_examples", total)).alias("max_examples"))
        expected = limited_rows(gold, longest.filter("max_examples > 0"), total).drop("max_examples")
        ensure_checkpoint_dir(problems.sparkSession)
        own = grade(expected, answers, key=key, mode=mode, order_col=order_col).checkpoint()
        first = [*gold.columns, *REQUEST_KEY, *names]
        graded = limited_rows(own, asked, total, on=names).select(*first, *[c for c in own.columns if c not in first])
    people = people.drop("max_examples")
    return Evaluation(report(graded, people, by=REQUEST_KEY), graded, people, errors)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--problems", required=True, nargs="+", help="candidate paths, first existing is read")
    ap.add_argument("--problems-format", default="csv")
    ap.add_argument("--answers", required=True)
    ap.add_argument("--answers-format", default="parquet")
    ap.add_argument("--request", required=True, help="request texts (JSON or tags): a file, a folder of files, or a table "
                    "(request_id, body)")
    ap.add_argument("--request-format", default="text", help="text (one request per file) or the table's format")
    ap.add_argument("--out", required=True)
    ap.add_argument("--mode", default="substring", choices=("substring", "last_line"))
    ap.add_argument("--key", help="row key of problems and answers (default: example_id, else sample_num)")
    ap.add_argument("--reply-order", help="column that orders several replies to one row")
    args = ap.parse_args(argv)

    spark = configure(SparkSession.builder.appName("answer_eval").getOrCreate())
    problems = read_problems(spark, args.problems, fmt=args.problems_format,
                             file_order=args.problems_format == "csv")
    if args.request_format == "text":       # one request per file
        files = spark.read.text(args.request, wholetext=True).select(
            F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("body"))
        request = number_samples(files, "file_path", col_name="request_id", start=0).select("request_id", "body")
    else:
        request = spark.read.format(args.request_format).load(args.request).select("request_id", "body")
    broken = None
    if args.answers_format == "json":
        log, broken = read_answer_log(spark, args.answers)
    else:
        log = read_answers(spark, args.answers, fmt=args.answers_format)
    answers = decode_envelope(log)
    ev = evaluate(problems, request, answers, key=args.key, mode=args.mode, order_col=args.reply_order)
    out = args.out.rstrip("/")
    # graded once: the report is made from the written rows, the documents from the written report
    write_results(ev.graded, f"{out}/results")
    graded = spark.read.schema(ev.graded.schema).parquet(f"{out}/results")
    report(graded, ev.people, by=REQUEST_KEY).write.mode("overwrite").parquet(f"{out}/report")
    written = spark.read.parquet(f"{out}/report")
    write_parts(json_parts(written, REQUEST_KEY), f"{out}/report_json")
    write_parts(text_parts(written, REQUEST_KEY), f"{out}/report_text")
    ev.errors.write.mode("overwrite").json(f"{out}/request_errors")
    if broken is not None:
        broken.write.mode("overwrite").json(f"{out}/answer_errors")
        written = spark.read.schema(broken.schema).json(f"{out}/answer_errors")
        broken_counts(written).write.mode("overwrite").json(f"{out}/answer_error_counts")


if __name__ == "__main__":
    main()
