"""Command lines: keyword search, SPARQL queries, fuzzy search.

    python -m tessera.plans.cli search DOCUMENTS.tsv [-k 3] [-b 0.75] [--k1 1.75]
    python -m tessera.plans.cli sparql TRIPLES.tsv QUERY.rq
    python -m tessera.plans.cli fuzzy ENTITIES.tsv [-k 5] [--synonyms]

search and fuzzy answer one query a line until the input ends or an empty line.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession, functions as F

from ..operators import fuzzy, inverted, sparql
from ..sources import readers, writers


def queries_of(lines: Iterable[str]) -> Iterator[str]:
    for line in lines:
        if not line.strip():
            return
        yield line.strip()


def search(spark: SparkSession, args: argparse.Namespace, lines: Iterable[str]) -> Iterator[str]:
    """Up to k documents with the keywords marked, and the number of all that match."""
    docs = readers.documents_tsv(spark, args.documents).cache()
    postings = inverted.bm25_postings(docs, inverted.doc_text("title", "description"), b=args.b, k=args.k1).cache()
    for text in queries_of(lines):
        words = inverted.keywords_of(text)
        rows = inverted.fetch(inverted.search_with_total(postings, text, args.k), docs).orderBy(F.desc("score"), "doc_id")
        marked = rows.select("total", *(inverted.highlight(F.col(c), words).alias(c) for c in ("title", "description"))).collect()  # k rows
        for r in marked:
            yield f"{r['title']}\n{r['description']}\n"
        yield f"{marked[0]['total'] if marked else 0:,} documents"


def run_sparql(spark: SparkSession, args: argparse.Namespace, lines: Iterable[str]) -> Iterator[str]:
    """The rows of a query file, their number and the seconds taken; a message if the query is not of the supported form."""
    try:
        parsed = sparql.parse(readers.sparql_file(spark, args.query))
    except ValueError as wrong:
        yield f"invalid query: {wrong}"
        return
    began = time.perf_counter()
    rows = sparql.run(readers.triples_tsv(spark, args.triples), parsed).cache()
    yield writers.shown(rows)
    yield f"{rows.count():,} rows in {time.perf_counter() - began:.2f} s"


def run_fuzzy(spark: SparkSession, args: argparse.Namespace, lines: Iterable[str]) -> Iterator[str]:
    """Up to k entities by prefix distance and score, then the run's statistics."""
    entities = readers.entities_tsv(spark, args.entities).cache()
    names = fuzzy.names_of(entities, args.synonyms).cache()
    postings = fuzzy.qgram_postings(names).cache()
    for text in queries_of(lines):
        prefix, began = fuzzy.normalized(text), time.perf_counter()
        if not prefix:
            yield "no letters to search for"
            continue
        found = fuzzy.find_matches(postings, names, entities, prefix, k=args.k)
        named = found.join(entities.select("ent_id", "name", "info"), "ent_id").orderBy("ped", F.desc("score"), "ent_id").collect()  # k rows
        for r in named:
            yield f"{r['name']} (distance {r['ped']}, score {r['score']}): {', '.join(r['info'])}"
        counts = fuzzy.match_stats(postings, names, prefix, fuzzy.delta_for(prefix)).first()
        yield f"{counts['lists']} lists, {counts['candidates']} candidates, {counts['distances']} distances, {counts['matches']} matches, {time.perf_counter() - began:.2f} s"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    of = top.add_subparsers(dest="command", required=True)
    one = of.add_parser("search")
    one.add_argument("documents")
    one.add_argument("-k", type=int, default=3)
    one.add_argument("-b", type=float, default=0.75)
    one.add_argument("--k1", type=float, default=1.75)
    one.set_defaults(run=search)
    one = of.add_parser("sparql")
    one.add_argument("triples")
    one.add_argument("query")
    one.set_defaults(run=run_sparql)
    one = of.add_parser("fuzzy")
    one.add_argument("entities")
    one.add_argument("-k", type=int, default=5)
    one.add_argument("--synonyms", action="store_true")
    one.set_defaults(run=run_fuzzy)
    return top


def main(words: list[str], spark: SparkSession, lines: Iterable[str], out: Callable[[str], object] = print) -> None:
    args = parser().parse_args(words)
    for line in args.run(spark, args, lines):
        out(line)


if __name__ == "__main__":
    main(sys.argv[1:], SparkSession.builder.appName("tessera").getOrCreate(), sys.stdin)
