"""Command line: `python -m gleaner.cli QUESTION --corpus DIR`. The corpus folder holds documents.parquet."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path

from .functions import fixed


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleaner", description="Evidence for questions, from search engines or a corpus.")
    p.add_argument("question", nargs="*", help="questions; - reads them from standard input, one a line")
    p.add_argument("--corpus", help="folder with documents.parquet that is searched instead of the web")
    p.add_argument("-r", "--max-rounds", type=int)
    p.add_argument("-b", "--breadth", type=int)
    p.add_argument("--follow-up", type=int)
    p.add_argument("--per-engine", type=int)
    p.add_argument("-k", "--fetch-top-k", type=int)
    p.add_argument("-n", "--max-sources", type=int)
    p.add_argument("--summary-sentences", type=int)
    p.add_argument("--min-content-chars", type=int)
    p.add_argument("--no-fetch", dest="fetch_pages", action="store_false", default=None)
    p.add_argument("-f", "--format", choices=("markdown", "json", "brief"), default="markdown")
    p.add_argument("-o", "--out", help="folder for bundle.json, report.md and sources")
    p.add_argument("-c", "--config", help="file of name: value lines")
    p.add_argument("--intent", choices=tuple(fixed.INTENT_ENGINES))
    p.add_argument("--engines", nargs="+", help="engines to ask besides the intent's own")
    p.add_argument("--exclude-engines", nargs="+", help="engines not to ask")
    p.add_argument("--timeout", type=float)
    p.add_argument("--round-timeout", type=float)
    p.add_argument("--retries", type=int)
    p.add_argument("--min-interval", type=float)
    p.add_argument("--cache-ttl", type=int)
    p.add_argument("--no-cache", dest="cache", action="store_false", default=None)
    p.add_argument("--ignore-robots", dest="respect_robots", action="store_false", default=None)
    p.add_argument("--list-engines", action="store_true")
    p.add_argument("--show-config", action="store_true")
    return p


def configured(args: argparse.Namespace):
    """Options count more than the file, the file more than defaults."""
    from .plans.session import Config, read_config

    found = read_config(Path(args.config).read_text("utf-8")) if args.config and Path(args.config).exists() else {}
    return Config.of_sections(found, vars(args))


def main(argv: list[str] | None = None, transport=None) -> int:
    args = parser().parse_args(argv)
    if args.list_engines:
        for e in fixed.ENGINES:
            print(f"{e[0]:14} {e[2]:10} {e[3]:.2f} tier {e[4]}  {e[1]}")
        return 0
    config = configured(args)
    if args.show_config:
        print(json.dumps(asdict(config), indent=2))
        return 0
    asked = [q.strip() for q in (sys.stdin if args.question == ["-"] else args.question) if q.strip()]
    if not asked:
        parser().print_usage(sys.stderr)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import evidence as ev
    from .operators import planning
    from .plans import inputs, report, session
    from .sources import fetch

    spark = SparkSession.builder.appName("gleaner").getOrCreate()
    q = spark.createDataFrame([(n, x) for n, x in enumerate(asked, 1)], "qid long, query string")
    if args.corpus:
        q = q.withColumn("intent", ev.intent(F.col("query"), F.lit(config.intent).cast("string")))
        corpus, empty = inputs.corpus(spark, args.corpus), F.array().cast("array<string>")
        scored = ev.score_sources(corpus, None, q, config.now_year, config.weights).where(F.col("idx") <= config.fetch_top_k * config.max_rounds)
        sources = scored.select("qid", "sid").join(corpus, "sid").withColumns({"queries": empty, "facets": empty})
        done = session.finish(sources, q, config) | {"plan": planning.plan(q, config.breadth)}
    else:
        done = session.search(spark, q, *session.web(config, transport or fetch.default_transport), config)
        q = done["questions"]
    bundles = report.build_bundles(q, done["scored"], done["corpus"], done["summary"], done["quotes"], done["divergences"], done["coverage"], done["facets"], done["plan"])
    render = {"markdown": report.as_markdown, "json": report.as_json, "brief": report.as_brief}[args.format]
    for row in bundles.orderBy("qid").toLocalIterator():
        bundle = row["bundle"].asDict(recursive=True)
        print(render(bundle))
        if args.out:
            wanted = [s["sid"] for s in bundle["sources"] or []]
            texts = {r["sid"]: r["content"] for r in done["corpus"].where(F.col("sid").isin(wanted)).select("sid", "content").collect()}
            report.write_files(bundle, texts, args.out if len(asked) == 1 else f"{args.out}/{row['qid']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
