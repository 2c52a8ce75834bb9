"""Subjects, sub-queries of the first round and follow-ups. A question's plan is a short sequential choice, so it is made in a
grouped function for each question; what it needs (subject, facets, coverage, terms) is computed set-wise before."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

PLAN = "qid long, ord int, text string, facet string, reason string, round int, weight double"


def subject(query: Column) -> Column:
    """What a question is about: parts that ask or name a facet go; the whole question if nothing is left."""
    whole = F.regexp_replace(F.coalesce(query, F.lit("")), r"(?U)^\s+|\s+$", "")
    left = whole
    for pattern in (f"(?i){fixed.ASK_PREFIX}", fixed.ASK_SUFFIX, fixed.FACET_TAIL, fixed.MARKS_TAIL, f"(?i){fixed.ASK_PREFIX}"):
        left = F.regexp_replace(left, pattern, "")
    left = F.regexp_replace(left, r"(?U)^\s+|\s+$", "")
    return F.when(left == "", whole).otherwise(left)


# ---- words of short texts, for the sequential choices (Columns do this for whole tables) --------------------------------

_WORD, _RUN, _STOP = re.compile(fixed.LATIN_WORD), re.compile(fixed.CJK + "+"), frozenset(fixed.STOP_WORDS)


def tokens(s: str) -> list[str]:
    pairs = [t for r in _RUN.findall(s or "") for t in ([r] if len(r) <= 2 else [r[k : k + 2] for k in range(len(r) - 1)])]
    words = [w.lower().strip(".-_") for w in _WORD.findall(s or "")]
    return pairs + [w for w in words if len(w) >= 2 and w not in _STOP]


def alike(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


class Asked:
    """Queries that were asked; a new one too much like them is not asked again."""

    def __init__(self, before=()):
        self.sets = [set(tokens(q)) for q in before]

    def take(self, q: str) -> bool:
        own = set(tokens(q))
        if any(alike(own, s) >= 0.75 for s in self.sets):
            return False
        self.sets.append(own)
        return True


_FACETS = {f[0]: f for f in fixed.FACETS}


def templates(facet: str, about: str, english: bool) -> list[str]:
    return [t.replace("{s}", about) for t in _FACETS[facet][3 if english else 2]] if facet in _FACETS else []


def facet_order(query: str, intent: str) -> list[str]:
    """Facets of the question's kind, then of its intent; those that the question names already come last."""
    kind = next((f for pattern, f in fixed.QUESTION_FACETS if re.search(pattern, query, re.I)), [])
    every = list(dict.fromkeys([*kind, *fixed.INTENT_FACETS.get(intent, fixed.DEFAULT_FACETS)]))
    named = lambda f: any(w.lower() in query.lower() for w in _FACETS[f][4])
    return [f for f in every if not named(f)] + [f for f in every if named(f)]


def plan_one(query: str, about: str, intent: str, breadth: int = 5, explicit=(), include_original: bool = True) -> list[tuple]:
    """(text, facet, reason, round, weight) of the first round's sub-queries."""
    query = (query or "").strip()
    if not query:
        return []
    asked, out = Asked(), []
    if include_original:
        asked.take(query)
        out.append((query, "original", "原始问题", 1, 1.0))
    explicit = [q.strip() for q in explicit or () if q and q.strip()]
    if explicit:
        return (out + [(q, "explicit", "外部规划", 1, 0.95) for q in explicit if asked.take(q)])[: breadth + 1]
    if re.search(fixed.ADVANCED_PLAN, query, re.I):
        return out
    english = not re.search(fixed.CJK, about)
    facets = facet_order(query, intent)
    turns = [(f, t[k]) for k in range(4) for f in facets if k < len(t := templates(f, about, english))]
    for facet, q in turns:  # one template of each facet before the second of any
        if len(out) >= breadth:
            break
        if q.strip() != query and asked.take(q):
            out.append((q, facet, _FACETS[facet][1], 1, 0.85))
    return out


def follow_one(about: str, asked: list[str], gaps: list[str], terms: list[str], round_no: int, most: int = 4, disputes=()) -> list[tuple]:
    """Sub-queries for what is missing: facets without evidence, salient terms, disputed points."""
    english, seen, out = not re.search(fixed.CJK, about), Asked(asked), []
    for facet in gaps:
        q = next((q for q in templates(facet, about, english) if seen.take(q)), None) if len(out) < most else None
        if q:
            out.append((q, facet, f"缺口补搜：{_FACETS[facet][1]}", round_no, 0.8))
    for term in terms:
        q = f"{about} {term}"
        if len(out) < most and len(term) >= 2 and term not in about and len(q) >= 4 and seen.take(q):
            out.append((q, "entity", f"深挖实体「{term}」", round_no, 0.7))
    for point in list(disputes or ())[:2]:
        q = f"{point} 争议 不同观点"
        if len(out) < most and seen.take(q):
            out.append((q, "counter", f"验证分歧：{point[:24]}", round_no, 0.75))
    return out


def salient(scored: list[tuple[float, str]], top_n: int) -> list[str]:
    """The best terms, without parts of other picked terms, longest first."""
    picked: list[str] = []
    for _, t in sorted(scored, key=lambda x: (-x[0], -len(x[1]))):
        if not any(t in p for p in picked):
            picked.append(t)
            if len(picked) >= 3 * top_n:
                break
    return [t for t in sorted(picked, key=len, reverse=True) if not any(t != p and t in p for p in picked)][:top_n]


def plan(questions: DataFrame, breadth: int = fixed.DEFAULTS["breadth"]) -> DataFrame:
    """questions(qid, query, intent[, explicit]) to sub-queries of the first round. Each row is planned by itself."""
    about = questions.withColumn("subject", subject(F.col("query")))
    about = about if "explicit" in questions.columns else about.withColumn("explicit", F.array().cast("array<string>"))

    def run(batches):
        for pdf in batches:
            rows = [(r.qid, n, *x) for r in pdf.itertuples() for n, x in enumerate(plan_one(r.query, r.subject, r.intent, breadth, list(r.explicit) if r.explicit is not None else ()), 1)]
            yield pd.DataFrame(rows, columns=["qid", "ord", "text", "facet", "reason", "round", "weight"])

    return about.select("qid", "query", "subject", "intent", "explicit").mapInPandas(run, PLAN)


def follow_up(state: DataFrame, round_no: int, most: int = fixed.DEFAULTS["follow_up"]) -> DataFrame:
    """state(qid, query, asked array, gaps array, terms array[, disputes array]): one row for each question."""
    about = state.withColumn("subject", subject(F.col("query")))
    about = about if "disputes" in state.columns else about.withColumn("disputes", F.array().cast("array<string>"))

    def run(batches):
        for pdf in batches:
            rows = [(r.qid, n, *x) for r in pdf.itertuples() for n, x in enumerate(follow_one(r.subject, list(r.asked), list(r.gaps), list(r.terms), round_no, most, list(r.disputes)), 1)]
            yield pd.DataFrame(rows, columns=["qid", "ord", "text", "facet", "reason", "round", "weight"])

    return about.select("qid", "subject", "asked", "gaps", "terms", "disputes").mapInPandas(run, PLAN)


def salient_terms(texts: DataFrame, questions: DataFrame, top_n: int = 6, min_freq: int = 2) -> DataFrame:
    """texts(qid, text), questions(qid, query) to (qid, terms): CJK terms with varied neighbours and frequent long Latin words,
    without the question's own. Counting is set-wise; only the words that stay meet in a question's row."""
    from ..functions import text as t
    from . import evidence as ev

    found = ev.discover_terms(texts, min_freq=min_freq).where(~F.col("term").isin(fixed.STOP_WORDS) & (F.length("term") >= 2)).select("qid", "term", "score")
    latin = texts.select("qid", F.posexplode(F.transform(F.regexp_extract_all("text", F.lit(f"({fixed.LATIN_WORD})"), 1), lambda w: F.lower(w))).alias("p", "term")).where((F.length("term") >= 4) & ~F.col("term").isin(fixed.STOP_WORDS))
    counts = latin.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first"))
    latin = ev.top_k(counts, [F.desc("n"), "first", "term"], top_n).where(F.col("n") >= min_freq).select("qid", "term", (F.col("n") * 2.0).alias("score"))
    own = questions.select("qid", F.explode(t.token_set(F.col("query"))).alias("term"))
    scored = ev.top_k(found.unionByName(latin).join(own, ["qid", "term"], "left_anti"), [F.desc("score"), F.desc(F.length("term")), "term"], 50 * top_n)
    picked = scored.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("idx", "score", "term"))).alias("rows"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"qid": pdf.qid, "terms": [salient([(r["score"], r["term"]) for r in rows], top_n) for rows in pdf.rows]})

    return picked.mapInPandas(run, "qid long, terms array<string>")
