"""The round loop: plan, search, rank, fetch, extract, look for gaps, follow up. The driver only decides whether to go on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions import fixed, html
from ..operators import evidence as ev
from ..operators import planning, selection
from ..sources import connectors, fetch
from .store import stored


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


@dataclass(frozen=True)
class Config:
    """Settings of a run. Empty weights mean the built-in ones."""

    max_rounds: int = fixed.DEFAULTS["max_rounds"]
    breadth: int = fixed.DEFAULTS["breadth"]
    follow_up: int = fixed.DEFAULTS["follow_up"]
    per_engine: int = fixed.DEFAULTS["per_engine"]
    fetch_top_k: int = fixed.DEFAULTS["fetch_top_k"]
    max_sources: int = fixed.DEFAULTS["max_sources"]
    summary_sentences: int = fixed.DEFAULTS["summary_sentences"]
    min_content_chars: int = fixed.DEFAULTS["min_content_chars"]
    fetch_pages: bool = fixed.DEFAULTS["fetch_pages"]
    timeout: float = 12.0
    round_timeout: float = 35.0
    concurrency: int = 6
    retries: int = 1
    min_interval: float = 0.6
    cache: bool = True
    cache_ttl: int = 900
    respect_robots: bool = True
    intent: str | None = None
    engines: tuple[str, ...] = ()
    exclude_engines: tuple[str, ...] = ()
    queries: tuple[str, ...] = ()
    weights: dict = field(default_factory=dict)
    engine_weights: dict = field(default_factory=dict)
    title_threshold: float = 0.86
    fingerprint_distance: int = 6
    now_year: int = 2026

    @classmethod
    def of(cls, *layers: dict) -> Config:
        """Later layers count more; unknown names and None are left out. Lists become tuples."""
        known = {f.name for f in fields(cls)}
        found = {k: v for layer in layers for k, v in (layer or {}).items() if k in known and v is not None}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})

    @classmethod
    def of_sections(cls, raw: dict, *layers: dict) -> Config:
        """The sections of a settings file (the loop's own, `deduplication`, `ranking`, `engine_weights`), then layers that count more.
        Values that are no numbers where numbers belong are left out."""
        raw = raw if isinstance(raw, dict) else {}
        part = lambda name: raw[name] if isinstance(raw.get(name), dict) else {}
        named = {"deduplication", "ranking", "engine_weights"}
        own = [v for k, v in raw.items() if isinstance(v, dict) and k not in named]
        same = part("deduplication")
        title, bits = (same.get(k) for k in ("title_similarity_threshold", "fingerprint_hamming_distance"))
        given = {
            "weights": {k: float(v) for k, v in part("ranking").items() if _number(v)}, "engine_weights": {k: float(v) for k, v in part("engine_weights").items() if _number(v)},
            "title_threshold": float(title) if _number(title) else None, "fingerprint_distance": int(bits) if _number(bits) else None,
        }
        return cls.of(*own, {k: v for k, v in raw.items() if not isinstance(v, dict)}, given, *layers)


def read_config(source: str) -> dict:
    """Two levels of `name: value` as in YAML; comments and quotes go, numbers, booleans, null and [lists] become such; {} where nothing fits."""
    out: dict = {}
    section = out
    for line in source.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#") or ":" not in bare:
            continue
        name, value = (x.strip() for x in bare.split(":", 1))
        name = name.strip("\"'")
        if not value:
            if bare[0] != " ":
                section = out[name] = {}
            continue
        (section if bare[0] == " " else out)[name] = [_value(x.strip()) for x in value[1:-1].split(",") if x.strip()] if value[0] == "[" and value[-1] == "]" else _value(value)
    return out


def _value(x: str):
    bare = x.strip("\"'")
    if bare != x:
        return bare
    number = x.replace(".", "", 1).lstrip("-").isdigit()
    return {"true": True, "false": False, "null": None, "~": None}.get(x.lower(), (float(x) if "." in x else int(x)) if number else x)


def search(spark: SparkSession, questions: DataFrame, engine: Callable[[DataFrame], DataFrame], pages: Callable[[DataFrame], DataFrame], config: Config = Config(), store: Callable[[DataFrame, str], DataFrame] = stored) -> dict[str, DataFrame]:
    """questions(qid, query). engine: tasks(qid, engine_id, sent) to hits(qid, engine_id, query, position, title, url, snippet);
    pages: (url) to (url, html). store keeps a round's table. Returns the tables of a report."""
    names = lambda x: F.array(*[F.lit(e) for e in x]).cast("array<string>")
    q = store(questions.withColumn("intent", ev.intent(F.col("query"), F.lit(config.intent).cast("string"))), "questions")
    engines = ev.engines_table(spark)
    if config.engine_weights:
        engines = ev.engine_weights(engines, spark.createDataFrame([(k, str(v)) for k, v in config.engine_weights.items()], "id string, w string"))
    plan = store(planning.plan(q, config.breadth), "plan")
    asked, sources, seen = plan, None, None
    for round_no in range(1, config.max_rounds + 1):
        routes = ev.route(q.select("qid", "query", F.col("intent").alias("hint"), names(config.engines).alias("include"), names(config.exclude_engines).alias("exclude")))
        tasks = ev.search_tasks(plan.select("qid", "text", "facet"), routes, engines)
        hits = engine(tasks).where(F.col("position") <= config.per_engine)
        hits = hits.withColumn("ord", F.row_number().over(W.partitionBy("qid").orderBy("engine_id", "query", "position", "url")))
        ranked = store(ev.rank_hits(hits, q, engines, seen).where(F.col("rank") <= config.fetch_top_k), f"ranked-{round_no}")
        got = fetched(ranked, pages, config) if config.fetch_pages else unfetched(ranked)
        got = store(got, f"sources-{round_no}")
        sources = got if sources is None else sources.unionByName(got)
        seen = ranked.select("qid", "key") if seen is None else seen.unionByName(ranked.select("qid", "key"))
        cover = ev.facet_coverage(sources.select("qid", F.when(F.col("content") != "", F.col("content")).otherwise(F.col("snippet")).alias("text")))
        if round_no == config.max_rounds or not config.fetch_pages:
            break
        # A question goes on while it has gaps or too few sources.
        full = sources.where(F.length("content") >= 200).groupBy("qid").agg(F.count(F.lit(1)).alias("full"))
        gaps = ev.empty_facets(cover, q.select("qid", "intent")).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "facet"))), lambda x: x["facet"]).alias("gaps"))
        texts = ev.top_k(sources.where(F.length("content") >= 200).select("qid", "sid", F.col("content").alias("text")), ["sid"], 12)
        empty = F.array().cast("array<string>")
        state = q.select("qid", "query").join(gaps, "qid", "left").join(full, "qid", "left").join(planning.salient_terms(texts, q), "qid", "left").join(asked.groupBy("qid").agg(F.collect_list("text").alias("asked")), "qid")
        state = state.withColumns({"gaps": F.coalesce("gaps", empty), "terms": F.coalesce("terms", empty)}).where((F.size("gaps") > 0) | (F.coalesce("full", F.lit(0)) < config.max_sources))
        plan = store(planning.follow_up(state, round_no + 1, config.follow_up), f"plan-{round_no + 1}")
        if plan.isEmpty():
            break
        asked = asked.unionByName(plan)
    return {"questions": q, "plan": asked, "sources": sources, **finish(sources, q, config, store)}


def web(config: Config, transport: Callable = fetch.default_transport) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """engine and pages of search(), over a transport."""

    def pages(wanted: DataFrame) -> DataFrame:
        requests = wanted.select("url", F.lit(config.timeout).alias("timeout"), F.lit(config.respect_robots).alias("check_robots"))
        return stored(fetch.fetch(requests, transport, config.min_interval).where("error = ''").select("url", F.col("body").alias("html")), "pages")

    return lambda tasks: stored(connectors.ask(tasks, stored, transport, config.per_engine, config.min_interval), "hits"), pages


def fetched(ranked: DataFrame, pages: Callable[[DataFrame], DataFrame], config: Config) -> DataFrame:
    """Pages of the picked addresses, each fetched and extracted once, whatever the number of questions."""
    found = pages(ranked.select("url").distinct()).withColumn("a", html.articles(config.now_year)("html", "url")).select("url", F.lit(True).alias("fetched"), "a")
    own = ranked.join(found, "url", "left").select(
        "qid", F.xxhash64("key").alias("sid"), "url", F.when(F.coalesce("a.title", F.lit("")) != "", F.col("a.title")).otherwise(F.col("title")).alias("title"), "snippet", F.coalesce("a.text", F.lit("")).alias("content"), "engines",
        F.array().cast("array<string>").alias("queries"), F.array().cast("array<string>").alias("facets"), F.coalesce("a.published", F.lit("")).alias("published"), "fetched",
    )
    return ev.source_status(own, config.min_content_chars).withColumn("content", F.when(F.col("status") == "ok", F.col("content")).otherwise(F.lit(""))).drop("fetched")


def unfetched(ranked: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return ranked.select("qid", F.xxhash64("key").alias("sid"), "url", "title", "snippet", F.lit("").alias("content"), "engines", empty.alias("queries"), empty.alias("facets"), F.lit("").alias("published"), F.when(F.col("snippet") != "", "ok").otherwise("empty").alias("status"))


def finish(sources: DataFrame, questions: DataFrame, config: Config, store: Callable[[DataFrame, str], DataFrame] = stored) -> dict[str, DataFrame]:
    """What a report needs of the sources of all rounds."""
    stands = selection.dedupe(sources, config.title_threshold, config.fingerprint_distance).where("NOT merged")
    kept = sources.drop("engines", "queries", "facets", "snippet").join(stands.select("qid", "sid", "engines", "queries", "facets", "snippet"), ["qid", "sid"])
    kept = store(kept, "kept")
    scored = ev.score_sources(kept.dropDuplicates(["sid"]), kept.select("qid", "sid"), questions, config.now_year, config.weights).join(kept.select("qid", "sid", "status", "snippet"), ["qid", "sid"])
    scored = scored.where((F.col("status") == "ok") | (F.col("snippet") != "")).drop("status", "snippet")
    scored = scored.withColumn("idx", F.row_number().over(W.partitionBy("qid").orderBy("idx"))).where(F.col("idx") <= config.max_sources)
    scored = store(scored, "scored")
    best = store(scored.select("qid", "sid", "idx", "score").join(kept, ["qid", "sid"]), "best")
    summary = store(selection.extractive_summary(best, questions, config.summary_sentences), "summary")
    return {"scored": scored, "corpus": kept.dropDuplicates(["sid"]), "summary": summary, "quotes": selection.select_quotes(best, questions), "divergences": ev.divergences(summary), "coverage": ev.coverage_report(best, config.now_year), "facets": ev.facet_coverage(best.where(F.length("content") >= 200).withColumnRenamed("content", "text"))}


