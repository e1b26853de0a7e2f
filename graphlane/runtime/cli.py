"""python -m graphlane.runtime.cli --output FILE [--experiment-id ID] [--algorithm NAME] [--config k=v ...] [--yaml FILE]

Runs pagerank (by default), sssp, bfs or cc over the edge list of config `edges` (with `vertices`, `weighted`) and writes the result.
Ends with 2 for bad arguments and 1 if the result can't be written.
"""

from __future__ import annotations

import argparse
import platform
import subprocess
import sys
import time

from pyspark.sql import SparkSession

from graphlane import algorithms
from graphlane.runtime import Config, Result, scalars
from graphlane.sources import load_edge_list


def git_commit() -> str:
    found = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    return found.stdout.strip() if found.returncode == 0 else "uncommitted"


def measure(spark: SparkSession, algorithm: str, config: Config) -> dict[str, float]:
    graph = load_edge_list(spark, config.get("edges"), config.get_int("vertices"), config.contains("weighted") and config.get_bool("weighted"))
    began = time.perf_counter()
    if algorithm == "pagerank":
        r = algorithms.pagerank(graph, algorithms.PageRankOptions(float(config.get_or("damping", "0.85")), float(config.get_or("tolerance", "1e-6")), int(config.get_or("max_iterations", "100"))))
        own = {"iterations": r.iterations, "residual": r.residual, "converged": float(r.converged)}
    elif algorithm in ("sssp", "bfs"):
        source = int(config.get_or("source", "0"))
        r = algorithms.bfs(graph, source) if algorithm == "bfs" else algorithms.sssp(graph, algorithms.SSSPOptions(source))
        own = {"iterations": r.iterations, "converged": float(r.converged)}
    else:
        own = {"components": algorithms.connected_components(graph).select("component").distinct().count()}
    return own | {"runtime_seconds": time.perf_counter() - began, "vertices": graph.n, "edges": graph.m}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--output", required=True)
    p.add_argument("--experiment-id", default="experiment")
    p.add_argument("--algorithm", default="pagerank", choices=["pagerank", "sssp", "bfs", "cc"])
    p.add_argument("--config", action="append", default=[])
    p.add_argument("--yaml")
    a = p.parse_args(argv)
    config = Config()
    if a.yaml:
        with open(a.yaml, encoding="utf-8") as f:
            for k, v in scalars(f.read()).items():
                config.set(k, v)
    for pair in a.config:
        k, eq, v = pair.partition("=")
        if not k or not eq:
            p.error(f"not key=value: {pair}")
        config.set(k, v)
    spark = SparkSession.builder.getOrCreate()
    result = Result(a.experiment_id, a.algorithm, config=config.values() | {"git_commit": git_commit(), "runner": "graphlane", "python_version": platform.python_version(), "spark_version": spark.version})
    try:
        result.measurements = measure(spark, a.algorithm, config)
    except (ValueError, IndexError, RuntimeError, OSError) as e:
        result.status = "failed"
        result.config["error"] = str(e)
    return 0 if result.write(a.output) else 1


if __name__ == "__main__":
    sys.exit(main())
