"""Command lines: `python -m lodestore qps ...` and `python -m lodestore levels ...`.

qps replays a dataset as inserts and searches, paced, and prints latencies; levels
fills a collection with levels and searches it.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from .encoders import Encoder, HashingEncoder, PassthroughEncoder, TransformerEncoder
from .operators import memories, stats
from .plans import workload
from .plans.engine import Engine
from .plans.strategies import STRATEGIES
from .sources import datasets, loaders


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestore", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    q = commands.add_parser("qps", help="replay a dataset at one or more rates")
    q.add_argument("--config", help="YAML or JSON file whose values replace the other arguments")
    q.add_argument("--strategy", choices=sorted(STRATEGIES), default="exact")
    q.add_argument("--dataset", choices=sorted(loaders.BUILDERS), default="trajectories")
    q.add_argument("--path", help="folder with a folder for each split")
    q.add_argument("--split")
    q.add_argument("--limit", type=int, default=200, help="requests taken from the dataset; 0: all")
    q.add_argument("--prefill", type=int, default=0, help="leading texts that are there before the clock starts")
    q.add_argument("--qps", type=float, nargs="+", default=[50.0])
    q.add_argument("--mode", choices=workload.MODES, default="paired")
    q.add_argument("--ratio", default="1:1", help="searches to inserts, for mode ratio")
    q.add_argument("--k", type=int, default=3)
    q.add_argument("--nprobe", type=int, default=32)
    q.add_argument("--batch", type=int, default=256, help="texts of a request")
    q.add_argument("--dim", type=int, default=64)
    q.add_argument("--model", help="a transformer model; without one texts are hashed")
    q.add_argument("--dump", help="an index dump that the collection starts from")
    q.add_argument("--new-threshold", type=float, default=float("inf"))
    q.add_argument("--search-threshold", type=float, default=float("-inf"))
    q.add_argument("--out", help="folder that results are appended to, as CSV")
    v = commands.add_parser("levels", help="fill a collection with levels and search it")
    v.add_argument("--n", type=int, default=10_000)
    v.add_argument("--dim", type=int, default=128)
    v.add_argument("--k", type=int, default=10)
    v.add_argument("--nprobe", type=int, default=32)
    v.add_argument("--clusters", type=int, default=1)
    v.add_argument("--threshold", type=float, default=float("inf"), help="distance from which a vector opens a cluster")
    v.add_argument("--search-threshold", type=float, default=float("-inf"), help="distance of the k-th hit from which the settled level is searched too")
    return p


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    """Arguments, replaced by those of the configuration file; unknown names there are an error."""
    p = parser()
    args = p.parse_args(argv)
    for name, value in (datasets.config(args.config) if getattr(args, "config", None) else {}).items():
        key = name.replace("-", "_")
        if not hasattr(args, key):
            p.error(f"unknown setting in {args.config}: {name}")
        setattr(args, key, value)
    if args.command == "qps":
        args.qps = [float(x) for x in (args.qps if isinstance(args.qps, list) else [args.qps])]
        if not args.path:
            p.error("qps needs a path")
    return args


def qps(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    """Latencies of each kind of operation at each rate; a workload is generated by one client, so its texts are on the driver."""
    requests = loaders.Dataset(spark, args.dataset, args.path, args.split, args.limit).data()
    texts = [r["text"] for r in memories.flatten(requests).orderBy("agent", "request_index", "trace_index").collect()]
    encoder: Encoder = TransformerEncoder(args.model, args.dim) if args.model else HashingEncoder(args.dim)
    out = []
    for rate in args.qps:
        engine = Engine(spark, encoder, args.strategy, args.nprobe)
        index = engine.create_index(f"qps-{rate:g}", new_threshold=args.new_threshold, search_threshold=args.search_threshold)
        if args.dump:
            engine.restore(index, args.dump)
        if args.prefill > 0:
            engine.add_insert(index, [{"data": t} for t in texts[: args.prefill]])
            engine.run()
        timed = texts[max(0, args.prefill) :]
        rows = workload.drive(engine, index, [{"data": t} for t in timed], timed, args.mode, args.k, args.nprobe, args.batch, args.batch, text_ratio(args.ratio), qps=rate)
        summary = stats.latency_summary(rows)
        if args.out:
            datasets.append_result(summary, args.out)
        out.append({"qps": rate, "kinds": [r.asDict() for r in summary.collect()]})
        engine.close()
    return out


def text_ratio(ratio: str) -> tuple[int, int]:
    from .functions.text import parse_ratio

    return parse_ratio(ratio)


def levels(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Seconds of an insert and a search of as many as 1,024 of the same vectors, and how many hits there were."""
    engine = Engine(spark, PassthroughEncoder(args.dim), "multilevel", args.nprobe)
    index = engine.create_index("levels", "cosine", clusters=args.clusters, new_threshold=args.threshold, search_threshold=args.search_threshold)
    rows = datasets.synthetic(spark, args.n, args.dim).selectExpr("ext_id AS id", "vector AS data")
    began = time.perf_counter()
    engine.add_insert(index, rows)
    engine.run()
    stored = time.perf_counter()
    engine.add_search(index, rows.limit(1024), args.k, "levels")
    hits = engine.run().hits.count()
    out = {"rows": args.n, "insert_s": round(stored - began, 3), "search_s": round(time.perf_counter() - stored, 3), "hits": hits}
    engine.close()
    return out


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    spark = SparkSession.builder.appName("lodestore").getOrCreate()
    print(json.dumps({"qps": qps, "levels": levels}[args.command](spark, args)))


if __name__ == "__main__":
    main()
