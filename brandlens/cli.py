"""Command line: python -m brandlens.cli JOB --product P ... over a lake.

Fetching and asking need clients, which this package does not bring; pass --clients MODULE, a module with functions
``fetch(url) -> (status, body)`` and ``ask(prompt) -> text or None``.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.urls import default_sitemap
from .plans import jobs
from .sources import sitemap
from .sources.clients import robots_text
from .sources.lake import Lake, recorded_runs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="brandlens")
    commands = top.add_subparsers(dest="job", required=True)
    for name, words in (
        ("scrape", {"url": None, "mode": "quick", "quick-cap": 15, "delay": 300, "timeout": 10, "retries": 2, "concurrency": 3}),
        ("questions", {"brand": None, "competitors": ""}),
        ("aeo", {"brand": None, "competitors": None, "category": None, "mode": "quick", "prompts": 0, "runs": 0, "include-questions": "", "questions-runs": 2, "questions-limit": 0, "recorded": "", "log": "", "delay": 500, "timeout": 30, "retries": 2, "concurrency": 3, "temperature": 0.9}),
        ("clusters", {"method": "taxonomy"}),
    ):
        command = commands.add_parser(name)
        command.add_argument("--lake", required=True)
        command.add_argument("--product", required=True)
        command.add_argument("--clients")
        for word, default in words.items():
            command.add_argument(f"--{word}", default=default, required=default is None, type=str if default is None else type(default))
    return top


def names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    lake = Lake(spark or SparkSession.builder.getOrCreate(), args.lake)
    clients = importlib.import_module(args.clients) if args.clients else None
    if args.job in ("scrape", "aeo") and clients is None:
        raise SystemExit("--clients is needed")
    if args.job == "scrape":
        root = lake.spark.range(1).select(default_sitemap(F.lit(args.url))).first()[0]
        entries, xml = sitemap.site_entries(lake.spark, root, clients.fetch)
        robots, cap = robots_text(args.url, clients.fetch), args.quick_cap if args.mode == "quick" else None
        pacing = {"delay": args.delay / 1000, "timeout": float(args.timeout), "retries": args.retries}
        jobs.scrape(lake, args.product, entries, robots, clients.fetch, cap, xml, tasks=args.concurrency, **pacing)
    elif args.job == "questions":
        print(jobs.make_questions(lake, args.product, args.brand, names(args.competitors)))
    elif args.job == "aeo":
        count, runs = (10, 3) if args.mode == "quick" else (24, 6)
        asked = {"include": args.include_questions or None, "question_runs": args.questions_runs, "question_limit": args.questions_limit or None}
        asked["log"] = args.log or None
        asked["recorded"] = recorded_runs(lake, args.recorded) if args.recorded else None
        pacing = {"delay": args.delay / 1000, "timeout": float(args.timeout), "retries": args.retries, "tasks": args.concurrency, "temperature": args.temperature}
        print(jobs.audit(lake, args.product, args.brand, names(args.competitors), args.category, clients.ask, args.prompts or count, args.runs or runs, **asked, **pacing))
    else:
        jobs.cluster(lake, args.product, clients.ask if args.method == "llm" else None).show(50, False)


if __name__ == "__main__":
    main()
