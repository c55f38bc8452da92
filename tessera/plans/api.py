"""The search and relations requests as DataFrames and JSON, and a small HTTP server for them."""

from __future__ import annotations

import json
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, functions as F

from ..operators import fuzzy, similarity, sparql

INFO = ("wikidata_id", "description", "wikipedia_url", "img_url")


@dataclass
class Index:
    entities: DataFrame
    names: DataFrame
    postings: DataFrame
    triples: DataFrame | None = None
    q: int = 3


def search(index: Index, query: str, k: int = 5) -> tuple[DataFrame, int]:
    """The k best entities with their information, and how many match in all. An empty query matches nothing."""
    prefix = fuzzy.normalized(query)
    if not prefix:
        return index.entities.select("ent_id", "name", "score", "info").limit(0), 0
    found = fuzzy.find_matches(index.postings, index.names, index.entities, prefix, q=index.q)
    best = found.limit(k)
    rows = best.join(index.names.select("syn_id", F.col("name").alias("synonym")), "syn_id").join(index.entities.drop("score"), "ent_id")
    return rows.orderBy("ped", F.desc("score"), "ent_id").select("ent_id", "name", "synonym", "score", "ped", "info"), found.count()


def search_json(index: Index, query: str, k: int = 5) -> str:
    rows, total = search(index, query, k)
    results = []
    for r in rows.collect():  # k rows at most
        info = dict(zip(INFO, r["info"] or [], strict=False))
        results.append({"name": r["name"], "score": r["score"], "synonym": r["synonym"] if "synonym" in rows.columns else r["name"], **info})
    return json.dumps({"results": results, "total": total}, ensure_ascii=False)


def relations_json(index: Index, entity: str) -> str:
    assert index.triples is not None
    rows = sparql.relations(index.triples, entity).collect()  # one entity's predicates
    return json.dumps([{"predicate": r["predicate"], "object": r["objects"]} for r in rows], ensure_ascii=False)


def similar_documents(index: Index, vectors: DataFrame, title: str, k: int, digits: int | None = None) -> DataFrame:
    """The nearest k + 1 documents, itself first, of the entity whose name is nearest to title; vectors(ent_id, vec)."""
    prefix = fuzzy.normalized(title)
    best = fuzzy.find_matches(index.postings, index.names, index.entities, prefix, q=index.q, k=1).first()
    if best is None:
        return vectors.select("ent_id", F.lit(0.0).alias("sim")).limit(0)
    query = vectors.where(F.col("ent_id") == best["ent_id"]).first()
    return similarity.top_k(vectors, list(query["vec"]) if query else [], k + 1, "ent_id", digits=digits)


def respond(index: Index, method: str, target: str) -> tuple[int, str]:
    """(status, JSON body) of a request."""
    if method != "GET":
        return 405, json.dumps({"error": "only GET is allowed"})
    url = urlsplit(target)
    if ".." in unquote(url.path).split("/"):
        return 403, json.dumps({"error": "outside the served paths"})
    params = parse_qs(url.query)
    if url.path == "/api/search" and "q" in params:
        return 200, search_json(index, params["q"][0])
    if url.path == "/api/relations" and "id" in params and index.triples is not None:
        return 200, relations_json(index, params["id"][0])
    return 404, json.dumps({"error": "not found"})


def serve(index: Index, port: int, host: str = "127.0.0.1") -> HTTPServer:
    """A server, not started; serve_forever() answers one client at a time."""

    class Handler(BaseHTTPRequestHandler):
        timeout = 5

        def _answer(self) -> None:
            status, body = respond(index, self.command, self.path)
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _answer

        def log_message(self, *args) -> None:
            return

    return HTTPServer((host, port), Handler)
