"""Command line: python -m vecstrata --root PATH COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import random
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .sources.synthetic import synthetic_documents
from .types import EngineError, IndexConfig, Metric


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vecstrata")
    root = os.environ.get("VECSTRATA_ROOT")
    p.add_argument("--root", default=root, required=root is None, help="any Hadoop path: file:, hdfs:, s3a:; $VECSTRATA_ROOT if it is set")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("create-ns")
    c.add_argument("name")
    c.add_argument("--metric", default=str(Metric.COSINE))
    sub.add_parser("list-ns")
    sub.add_parser("delete-ns").add_argument("name")
    g = sub.add_parser("generate")
    g.add_argument("name")
    g.add_argument("--count", type=int, default=1000)
    g.add_argument("--dims", type=int, default=128)
    g.add_argument("--batch-size", type=int, default=100)
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("--vector", help="JSON array; random without it")
    q.add_argument("--top-k", type=int, default=10)
    q.add_argument("--metric")
    q.add_argument("--include-vectors", action="store_true")
    get = sub.add_parser("get")
    get.add_argument("name")
    get.add_argument("id", type=int)
    i = sub.add_parser("index")
    i.add_argument("name")
    i.add_argument("--max-posting-size", type=int)
    return p


def run(spark: SparkSession, args: argparse.Namespace, out=sys.stdout) -> int:
    engine = Engine(spark, args.root)
    say = lambda x: print(json.dumps(x, default=str), file=out)
    try:
        match args.command:
            case "create-ns":
                engine.create_namespace(args.name, args.metric)
                say({"created": args.name})
            case "list-ns":
                for r in engine.list_namespaces().collect():
                    say(r.asDict())
            case "delete-ns":
                engine.delete_namespace(args.name)
                say({"deleted": args.name})
            case "generate":
                say({"sequence": engine.namespace(args.name).upsert(synthetic_documents(spark, args.count, args.dims, args.batch_size))})
            case "query":
                ns = engine.namespace(args.name)
                vector = json.loads(args.vector) if args.vector else [random.uniform(-1, 1) for _ in range(ns.dimensions() or 0)]
                for r in ns.query(vector, args.top_k, args.metric, args.include_vectors).collect():
                    say(r.asDict(recursive=True))
            case "get":
                say(engine.namespace(args.name).get(args.id).asDict(recursive=True))
            case "index":
                ns = engine.namespace(args.name)
                config = IndexConfig(metric=ns.meta()["distance_metric"], max_posting_size=args.max_posting_size) if args.max_posting_size else None
                say(ns.build_index(config) or {"indexed": "nothing new"})
    except EngineError as e:
        say(e.body() | {"status": e.status})
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("vecstrata").getOrCreate(), parser().parse_args()))
