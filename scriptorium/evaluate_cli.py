"""python -m scriptorium.evaluate_cli retrieval|compare|gold --data DIR --out DIR [--index PATH] [--label base] [--base base --new other]

retrieval measures a run over the evaluation questions and writes it with its report; with an embedder of one's own (`main(..., embedder=...)`) the
passages are embedded anew, so two embedders can be compared. compare judges one run against another and refuses runs on different
questions. gold checks the evaluation questions, writes the checking sheet, and exits with 1 if there is a problem.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from scriptorium import cli
from scriptorium.operators import quality, reports, runs
from scriptorium.operators.search import Ranked
from scriptorium.plans import retrieval
from scriptorium.runtime import read_table, ship_package
from scriptorium.sources import model as models


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=("retrieval", "compare", "gold"))
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--index")
    p.add_argument("--label", default="base")
    p.add_argument("--base", default="base")
    p.add_argument("--new")
    args = p.parse_args(argv)
    if args.command == "compare" and not args.new:
        p.error("compare needs --new")
    return args


def main(argv: list[str] | None = None, spark: SparkSession | None = None, embedder: models.Embedder | None = None) -> int:
    args = parse(argv)
    spark = spark or SparkSession.builder.appName("scriptorium").getOrCreate()
    ship_package(spark)
    embedder = embedder or models.HashingEmbedder(256)
    if args.command == "retrieval":
        corpus = cli.load(retrieval.chunks_of(spark, args.data), args.index, embedder)
        questions = retrieval.queries_of(spark, args.data)
        ranked = Ranked.of(corpus, questions, models.embed(questions, "qid", "question", embedder, cli.PREFIX))
        labels = read_table(spark, args.data, "gold").select(F.col("id").alias("qid"), "doc", "question_type", "wording")
        runs.write_run(runs.run_of(ranked, retrieval.evidence_of(spark, args.data), labels), args.out, args.label)
        reports.write(reports.retrieval_report(runs.read_run(spark, args.out, args.label), args.label), f"{args.out}/retrieval_{args.label}_report")
    elif args.command == "compare":
        base, new = (runs.read_run(spark, args.out, label) for label in (args.base, args.new))
        reports.write(reports.comparison_report(base, new, args.base, args.new), f"{args.out}/comparison_{args.base}_{args.new}")
    else:
        gold, chunks = read_table(spark, args.data, "gold"), retrieval.chunks_of(spark, args.data)
        reports.write(reports.checking_sheet(gold, chunks), f"{args.out}/checking_sheet")
        problems = quality.gold_problems(gold, chunks)
        problems.write.mode("overwrite").json(f"{args.out}/problems")
        return int(problems.limit(1).count() > 0)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
