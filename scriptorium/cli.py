"""python -m scriptorium.cli --data DIR [--index PATH] [--build] [--question '...'] [--mode hybrid|bm25|dense] [--top-k N] [--no-llm] [--backend none|ollama] [--debug]

--build embeds the passages of DIR/chunks.parquet, stores vectors and inverted index under PATH with the fingerprint of the passages, and ends.
Without --question, questions are read line by line until an empty line. An index made from other passages is refused; without --index
the passages are indexed for this run. Passages and questions are embedded by the same embedder.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import labels, text as tx
from scriptorium.operators import index, pipeline
from scriptorium.operators.search import MODES, Corpus, Ranked
from scriptorium.plans import retrieval
from scriptorium.runtime import cut_lineage, ship_package, widen
from scriptorium.sources import model as models, records

PREFIX = "Represent this sentence for searching relevant passages: "


def positive(value: str) -> int:
    n = int(value)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--data", required=True)
    p.add_argument("--index")
    p.add_argument("--build", action="store_true")
    p.add_argument("--question")
    p.add_argument("--mode", choices=MODES, default="hybrid")
    p.add_argument("--top-k", type=positive, default=6)
    p.add_argument("--no-llm", action="store_true")
    p.add_argument("--backend", choices=("none", "ollama"), default="none")
    p.add_argument("--url", default="http://localhost:11434")
    p.add_argument("--model", default="qwen2.5:3b")
    p.add_argument("--debug", action="store_true")
    args = p.parse_args(argv)
    if args.build and not args.index:
        p.error("--build needs --index")
    return args


def embedded(chunks: DataFrame, embedder: models.Embedder) -> DataFrame:
    """(pos, vec) of the passages, each with its breadcrumb."""
    return models.embed(widen(chunks.select("pos", labels.index_text().alias("text"))), "pos", "text", embedder)


def build(chunks: DataFrame, path: str, embedder: models.Embedder) -> None:
    """Stores vectors, inverted index and what they were made from."""
    records.write_index(embedded(chunks, embedder), index.fingerprint(chunks), path, type(embedder).__name__)
    Corpus.build(chunks, chunks.sparkSession.read.parquet(f"{path}/vectors"), f"{path}/inverted")


def load(chunks: DataFrame, path: str | None, embedder: models.Embedder) -> Corpus:
    if path is None:
        return Corpus.build(chunks, cut_lineage(embedded(chunks, embedder)))
    return Corpus.read(chunks, records.read_index(chunks.sparkSession, path, index.fingerprint(chunks)), f"{path}/inverted")


def render(rows: list, debug: bool = False) -> str:
    """Text of the hits of one question."""
    out = []
    for r in rows:
        tag = f" ({r.reason})" if r.reason else f" (score {r.score:.4f})" if debug else ""
        out.append(f"[S{r.ord}] {r.citation}{tag}\n    {r.snippet}")
    return "\n".join(out) or "No passage was found."


def answer(corpus: Corpus, question: str, args: argparse.Namespace, embedder: models.Embedder) -> str:
    """Answer, warnings and sources of one question as text."""
    spark = corpus.chunks.sparkSession
    queries = spark.createDataFrame([("q", question)], "qid string, question string")
    ranked = Ranked.of(corpus, queries, models.embed(queries, "qid", "question", embedder, PREFIX))
    hits = cut_lineage(ranked.hits(args.mode, args.top_k))
    shown = hits.join(corpus.chunks, "pos").select("ord", "score", "reason", labels.citation().alias("citation"), tx.snippet(F.col("text")).alias("snippet")).orderBy("ord")
    reply = pipeline.ask(ranked, models.model_of(args.backend, args.url, args.model), args.mode, args.top_k, use_model=not args.no_llm).first()
    parts = [reply.answer, *(f"Warning: {w}" for w in reply.warnings), "", "Sources:", render(shown.collect(), args.debug)]  # the hits of one question
    if args.debug:
        parts.append(f"mode {reply['mode']}, cited {list(reply.cited)}, {reply.seconds:.1f} s")
    return "\n".join(parts)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, embedder: models.Embedder | None = None, lines=sys.stdin) -> str:
    args = parse(argv)
    spark = spark or SparkSession.builder.appName("scriptorium").getOrCreate()
    ship_package(spark)
    embedder = embedder or models.HashingEmbedder(256)
    chunks = retrieval.chunks_of(spark, args.data)
    if args.build:
        build(chunks, args.index, embedder)
        return f"indexed {chunks.count()} passages in {args.index}"
    corpus = load(chunks, args.index, embedder)
    text = ""
    for question in [args.question] if args.question else iter(lambda: lines.readline().strip(), ""):
        text = answer(corpus, question, args, embedder)
        print(text)
    return text


if __name__ == "__main__":
    main()
