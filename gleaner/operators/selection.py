"""Choices that depend on what was chosen before: de-duplication, quotes and summaries of one question's sources.

A question has at most max_rounds * fetch_top_k sources and a summary pool of at most max(60, 8 * sentences) sentences, so a
group is small whatever the corpus; each is one call of a grouped function."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text, urls
from . import evidence as ev
from .planning import alike, tokens


def similarity(a: str, b: str) -> float:
    """The larger of the shares of common characters (in order) and of common tokens."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else max(SequenceMatcher(None, a, b).ratio(), alike(set(tokens(a)), set(tokens(b))))


DEDUPED = "qid long, sid long, kept_sid long, merged boolean, engines array<string>, queries array<string>, facets array<string>, snippet string"


def keep_first(rows: list[dict], title_threshold: float, distance: int) -> list[dict]:
    """rows: thickest first, with key, title_key, chars, fingerprint. Each is kept or joins a kept one: by address, else by a
    close fingerprint with half a title in common, else by title (only with enough text)."""
    kept: list[dict] = []
    for r in rows:
        same = next((k for k in kept if k["key"] == r["key"]), None)
        if same is None and r["chars"] >= 200 and r["fingerprint"]:
            near = (k for k in kept if k["chars"] >= 200 and k["fingerprint"] and ((k["fingerprint"] ^ r["fingerprint"]) & (1 << 64) - 1).bit_count() <= distance)
            same = next((k for k in near if similarity(r["title_key"], k["title_key"]) >= 0.5), None)
        if same is None and r["chars"] >= 400 and len(r["title_key"]) >= 8:
            same = next((k for k in kept if len(k["title_key"]) >= 8 and similarity(r["title_key"], k["title_key"]) >= title_threshold), None)
        r["into"] = same or r
        if same is None:
            kept.append(r)
            continue
        same["engines"] = sorted({*same["engines"], *r["engines"]})
        same["queries"] = list(dict.fromkeys([*same["queries"], *r["queries"]]))
        same["facets"] = sorted({*same["facets"], *r["facets"]})
        same["snippet"] = same["snippet"] or r["snippet"]
    return rows


def dedupe(sources: DataFrame, title_threshold: float = 0.86, distance: int = 6) -> DataFrame:
    """sources(qid, sid, url, title, content, snippet, engines, queries, facets): for each the source that stands for it."""
    prints = ev.simhash(sources.select("sid", "content").dropDuplicates(["sid"]), "sid", text.content_tokens(F.substring("content", 1, fixed.MATCH_CHARS)))
    facts = sources.join(prints, "sid").select("qid", "sid", "engines", "queries", "facets", "snippet", urls.normalize(F.col("url")).alias("key"), text.title_key(F.col("title")).alias("title_key"), F.length("content").alias("chars"), "fingerprint")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(n=[-len(e) for e in pdf.engines], c=-pdf.chars).sort_values(["c", "n", "sid"])
        rows = keep_first([{**r, "engines": list(r["engines"]), "queries": list(r["queries"]), "facets": list(r["facets"]), "fingerprint": int(r["fingerprint"])} for r in pdf.to_dict("records")], title_threshold, distance)
        return pd.DataFrame([(r["qid"], r["sid"], r["into"]["sid"], r["into"] is not r, r["into"]["engines"], r["into"]["queries"], r["into"]["facets"], r["into"]["snippet"]) for r in rows], columns=[c.split()[0] for c in DEDUPED.split(", ")])

    return facts.groupBy("qid").applyInPandas(run, DEDUPED)


def most_relevant(pool: list[tuple[float, str, set]], most: int) -> list[int]:
    """Maximal marginal relevance: places in the pool, in the order of choice. A sentence like a chosen one is dropped."""
    left, chosen, sets = list(range(len(pool))), [], []
    while left and len(chosen) < most:
        value = lambda k: pool[k][0] - 2.2 * max((alike(pool[k][2], s) for s in sets), default=0.0)
        best = max(left, key=value)
        if value(best) <= 0:
            break
        left.remove(best)
        if all(alike(pool[best][2], s) < 0.85 for s in sets):
            chosen.append(best)
            sets.append(pool[best][2])
    return chosen


def extractive_summary(sources: DataFrame, questions: DataFrame, most: int = fixed.DEFAULTS["summary_sentences"]) -> DataFrame:
    """sources(qid, sid, idx, url, title, status, content, score) to (qid, pos, source_idx, sid, text, score, opposition)."""
    pool = ev.summary_candidates(sources, questions).where(F.col("rank") <= max(60, 8 * most)).join(sources.select("qid", "sid", "idx"), ["qid", "sid"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        own = pdf.to_dict("records")
        rows = [(own[k]["qid"], n, own[k]["idx"], own[k]["sid"], own[k]["sentence"], round(own[k]["base"], 3)) for n, k in enumerate(most_relevant([(r["base"], r["sentence"], set(r["tokens"])) for r in own], most), 1)]
        return pd.DataFrame(rows, columns=["qid", "pos", "source_idx", "sid", "text", "score"])

    chosen = pool.groupBy("qid").applyInPandas(run, "qid long, pos int, source_idx int, sid long, text string, score double")
    return chosen.withColumn("opposition", text.opposes(F.col("text")))


def select_quotes(sources: DataFrame, questions: DataFrame, n: int = 3) -> DataFrame:
    """(qid, sid, pos, quote): the best sentences of each source, none like another; the text's head where it has no sentence."""
    scored = ev.quote_scores(sources, questions)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[str] = []
        for s in pdf.sort_values("rank").sentence:
            if len(out) < n and not any(similarity(s, o) > 0.8 for o in out):
                out.append(s)
        return pd.DataFrame({"qid": pdf.qid.iloc[0], "sid": pdf.sid.iloc[0], "pos": range(1, len(out) + 1), "quote": out})

    chosen = scored.groupBy("qid", "sid").applyInPandas(run, "qid long, sid long, pos int, quote string")
    bare = sources.where((F.size(text.sentences(F.col("content"))) == 0) & (F.length("content") > 0))
    return chosen.unionByName(bare.select(F.col("qid").cast("long"), F.col("sid").cast("long"), F.lit(1).alias("pos"), text.squeeze(F.substring("content", 1, 220)).alias("quote")))
