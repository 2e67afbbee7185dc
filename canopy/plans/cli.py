"""A prompt over an index: build, insert, delete, knn, range, dbscan, dpc, info, config, test, bench, help, quit."""

from __future__ import annotations

import argparse
import logging
import shlex
import subprocess
import sys
from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from canopy.config import Config
from canopy.operators import build, cluster, diagnose, search, update
from canopy.sources.points import dims, first_points, read_binary

log = logging.getLogger("canopy")
COMMANDS = {"build": "b", "insert": "i", "delete": "d", "knn": "k", "range": "r", "dpc": "dp", "dbscan": "db", "test": "t", "bench": "be", "info": "in", "config": "c", "help": "h", "quit": "q"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="", exit_on_error=False)
    sub = top.add_subparsers(dest="command", required=True)
    made = {name: sub.add_parser(name, aliases=[short], exit_on_error=False) for name, short in COMMANDS.items()}
    made["build"].add_argument("path")
    made["build"].add_argument("-m", "--mode", choices=["auto", "exact", "sampled", "parts"], default="auto")
    made["build"].add_argument("-p", dest="mode", action="store_const", const="parts", help="over parts")
    made["build"].add_argument("-c", dest="mode", action="store_const", const="exact", help="exact")
    for name in ("insert", "delete"):
        made[name].add_argument("path")
    made["knn"].add_argument("k", type=int)
    made["knn"].add_argument("at", type=float, nargs="+")
    made["range"].add_argument("bounds", type=float, nargs="+", help="low high of each dimension")
    made["dbscan"].add_argument("eps", type=float)
    made["dbscan"].add_argument("points", type=int)
    made["dpc"].add_argument("dc", type=float)
    made["info"].add_argument("style", choices=[*diagnose.STYLES, "totals", "metrics"], nargs="?", default="stats")
    made["info"].add_argument("part", type=int, nargs="?", default=0)
    made["config"].add_argument("action", choices=["show", "load", "reset", "data"], nargs="?", default="show")
    made["config"].add_argument("path", nargs="?")
    return top


class Shell:
    def __init__(self, spark: SparkSession):
        self.spark, self.settings, self.index, self.buckets, self.parser = spark, Config(), None, None, parser()

    def run(self, line: str):
        """Run one line; gives a DataFrame, a text, or None for quit."""
        words = shlex.split(line.strip())
        if not words:
            return ""
        args = self.parser.parse_args([words[0].lower(), *words[1:]])
        name = next(k for k, v in COMMANDS.items() if args.command in (k, v))
        return getattr(self, name)(args)

    def _points(self, path):
        return read_binary(self.spark, path)

    def _built(self) -> build.Index:
        if self.index is None:
            raise ValueError("build an index first")
        return self.index

    def build(self, a):
        points = self._points(a.path)
        settings, self.buckets = replace(self.settings, dimensions=len(dims(points))), None
        if a.mode == "parts":
            self.index, self.buckets = build.build_parts(points, settings)
        else:
            self.index = build.build(points, settings, a.mode)
        return diagnose.stats(self.index.nodes)

    def insert(self, a):
        self.index = update.insert(self._built(), self._points(a.path))
        return diagnose.stats(self.index.nodes)

    def delete(self, a):
        self.index, n = update.delete(self._built(), self._points(a.path))
        return f"{n} points removed"

    def knn(self, a):
        query = self.spark.createDataFrame([(0, *a.at)], "id long, " + ", ".join(f"d{k} float" for k in range(len(a.at))))
        return search.knn(self._built(), query, a.k)

    def range(self, a):
        return search.in_box(self._built().points, list(zip(a.bounds[::2], a.bounds[1::2], strict=True)))

    def dbscan(self, a):
        return cluster.dbscan(self._built().points, a.eps, a.points)

    def dpc(self, a):
        return cluster.density_peaks(self._built().points, a.dc)

    def info(self, a):
        if a.style == "metrics":
            return str(diagnose.metrics(self.spark))
        if a.style == "totals":
            return diagnose.memory(self._built())[1]
        return diagnose.show_style(self._built(), a.style, self.buckets, a.part)

    def config(self, a):
        if a.action == "data":
            return first_points(self._built().points)
        self.settings = Config.load(a.path) if a.action == "load" else Config() if a.action == "reset" else self.settings
        return str(self.settings)

    def test(self, a):
        return subprocess.run([sys.executable, "-m", "pytest", "-q", "tests"], capture_output=True, text=True).stdout

    def bench(self, a):
        return subprocess.run([sys.executable, "bench.py"], capture_output=True, text=True).stdout

    def help(self, a):
        return self.parser.format_help()

    def quit(self, a):
        return None


def set_logging(level: str = "INFO", stream=None) -> None:
    """Where the log of the engine goes, and from which level on."""
    for old in list(log.handlers):
        log.removeHandler(old)
    handler = logging.StreamHandler(stream)
    handler.setFormatter(logging.Formatter("%(levelname)s %(message)s"))
    log.addHandler(handler)
    log.setLevel(level)


def main() -> None:
    set_logging()
    shell = Shell(SparkSession.builder.appName("canopy").getOrCreate())
    for line in sys.stdin:
        try:
            out = shell.run(line)
        except (argparse.ArgumentError, SystemExit, ValueError, PySparkException) as e:
            log.error("%s", e)
            continue
        if out is None:
            return
        if hasattr(out, "show"):
            print(diagnose.BOLD_RULE)
            out.show(truncate=False)
            print(diagnose.RULE)
        else:
            print(out)


if __name__ == "__main__":
    main()
