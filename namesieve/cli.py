"""Command line: python -m namesieve.cli evaluate | demo | stream-demo | card | errors | serve."""

from __future__ import annotations

import argparse
import csv
import json
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cipher import backend, error_study, key_pair, study_report
from .functions.text import positions
from .params import TAU
from .plans import demo
from .plans.benchmark import benchmark
from .sources import datasets
from .sources.reports import save_report, sse


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="namesieve", description="Approximate name screening between two parties.")
    out.add_argument("--cipher", default="plain", help="plain gives no confidentiality; tenseal needs that package")
    every = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        sub = every.add_parser(name, help=text)
        sub.add_argument("--data-path", default="data", help="folder of the ncvr_10k files")
        sub.add_argument("--dataset", default="ncvr_10k")
        return sub

    def screening(sub: argparse.ArgumentParser, k: int, db_limit: int, output: str) -> None:
        sub.add_argument("--k", type=int, default=k, help="number of clusters; 0: by --k-mode")
        sub.add_argument("--tau", type=float, default=TAU)
        sub.add_argument("--db-limit", type=int, default=db_limit, help="first records of the list; -1: all")
        sub.add_argument("--no-early-stop", action="store_true")
        sub.add_argument("--output-dir", default=output)

    sub = command("evaluate", "metrics, times and bytes of a data set")
    screening(sub, 50, -1, "artifacts/evaluation")
    sub.add_argument("--query-limit", type=int, default=-1)
    sub.add_argument("--k-mode", default="sqrt")
    sub.add_argument("--no-reuse-context", action="store_true")
    sub = command("demo", "a few queries, with what they matched")
    screening(sub, 10, 100, "artifacts/demo")
    sub.add_argument("--query-indices", type=positions, default=[2, 7, 26, 49, 100])
    sub = command("stream-demo", "the same step by step")
    screening(sub, 10, 100, "artifacts/stream")
    sub.add_argument("--query", help="one name to ask for; without it, the standard demonstration")
    command("card", "what a data set holds")
    sub = command("errors", "errors of the cipher, and decisions near the threshold")
    sub.add_argument("--samples", type=int, default=1000)
    sub = command("serve", "POST /api/run streams events; GET /api/dataset-info")
    sub.add_argument("--port", type=int, default=8000)
    return out


def _events(spark: SparkSession, a: argparse.Namespace, asked: dict) -> Iterator[dict]:
    """A run's events; asked: query_mode (demo, indices, text), query, query_indices, db_limit, k, tau, early_stop."""
    queries, names = datasets.load_dataset(spark, a.dataset, a.data_path, 0, max(asked.get("db_limit", 100), 0))
    if asked.get("query_mode") == "text" and asked.get("query"):
        queries = spark.createDataFrame([(0, asked["query"], None)], "query_id bigint, name string, label boolean")
    elif asked.get("query_mode") == "indices" and asked.get("query_indices"):
        n = queries.count()  # a request leaves out positions beyond the list, a command refuses them
        queries = datasets.pick(queries, [i for i in asked["query_indices"] if asked.get("strict") or 0 <= i < n], n)
    else:
        queries = demo.demo_queries(spark)
    yield from demo.steps(queries, names, asked.get("k", 10), asked.get("tau", TAU), asked.get("early_stop", True), a.cipher)


def _save_demo(done: dict, config: dict, folder: str, name: str) -> list[Path]:
    """The summary as JSON and the rows as CSV."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    files = [out / f"{name}.json", out / f"{name}.csv"]
    files[0].write_text(json.dumps({"config": config, **done["summary"], "rows": done["rows"]}, indent=2, ensure_ascii=False, default=str))
    with files[1].open("w", newline="") as f:
        w = csv.DictWriter(f, demo.COLUMNS)
        w.writeheader()
        w.writerows(done["rows"])
    return files


def server(spark: SparkSession, a: argparse.Namespace) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _begin(self, kind: str, status: int = 200) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Cache-Control", "no-cache")
            self.end_headers()

        def do_GET(self) -> None:
            if self.path != "/api/dataset-info":
                return self.send_error(404)
            card = datasets.card(*datasets.load_dataset(spark, a.dataset, a.data_path), a.dataset)
            self._begin("application/json")
            self.wfile.write(json.dumps(card, ensure_ascii=False).encode())

        def do_POST(self) -> None:
            if self.path != "/api/run":
                return self.send_error(404)
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                return self.send_error(400)
            self._begin("text/event-stream")
            try:
                for event in _events(spark, a, asked):
                    self.wfile.write(sse(event["event"], event).encode())
                    self.wfile.flush()
            except Exception as e:  # the stream has begun, so a failure is an event too
                self.wfile.write(sse("error", {"message": str(e)}).encode())

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", a.port), Handler)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("namesieve").getOrCreate()
    if a.command == "evaluate":
        config = {"dataset": a.dataset, "data_path": a.data_path, "k": a.k or None, "k_mode": a.k_mode, "tau": a.tau, "query_limit": a.query_limit, "db_limit": a.db_limit, "early_stop": not a.no_early_stop, "reuse_context": not a.no_reuse_context, "cipher": a.cipher}
        result = benchmark(spark, config)
        files = save_report(result, a.output_dir, a.dataset)
        print(json.dumps({part: result[part] for part in ("metrics", "confusion")}, indent=2), *map(str, files), sep="\n")
    elif a.command in ("demo", "stream-demo"):
        asked = {"db_limit": a.db_limit, "k": a.k or "sqrt", "tau": a.tau, "early_stop": not a.no_early_stop}
        if a.command == "demo":
            asked |= {"query_mode": "indices", "query_indices": a.query_indices, "strict": True}
        elif a.query:
            asked |= {"query_mode": "text", "query": a.query}
        done = {}
        for done in _events(spark, a, asked):
            if a.command == "stream-demo" or done["event"] == "complete":
                print(json.dumps(done, ensure_ascii=False, default=str))
        print(*map(str, _save_demo(done, asked, a.output_dir, a.command)), sep="\n")
    elif a.command == "card":
        print(json.dumps(datasets.card(*datasets.load_dataset(spark, a.dataset, a.data_path), a.dataset), indent=2, ensure_ascii=False))
    elif a.command == "errors":
        print(study_report(error_study(backend(key_pair(a.cipher)[0]), a.samples)))
    else:
        server(spark, a).serve_forever()
    return 0


def matches(rows: DataFrame) -> DataFrame:
    """Demonstration rows for display, with Y and N."""
    from .functions.text import yes_no

    return rows.withColumns({c: yes_no(F.col(c)) for c in ("expected_label", "predicted_match")})


if __name__ == "__main__":
    raise SystemExit(main())
