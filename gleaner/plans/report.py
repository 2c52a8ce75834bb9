"""Evidence bundles and their renderings. A bundle is one row for each question; a report is a function of its row."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls

# Numbers and headings of reports.
NUMBERS = "一二三四五六七八九十"
HEADINGS = {"points": "要点（抽取式，句末编号为来源）", "facets": "按主题面归纳", "divergences": "证据分歧 / 需交叉验证", "gaps": "证据缺口（未覆盖 / 覆盖薄弱）", "sources": "来源清单", "engines": "执行诊断", "warnings": "注意事项"}


def build_bundles(questions: DataFrame, scored: DataFrame, corpus: DataFrame, summary: DataFrame, quotes: DataFrame, divergences: DataFrame, coverage: DataFrame, facets: DataFrame, plan: DataFrame) -> DataFrame:
    """One row (qid, bundle) for each question: everything about it as nested arrays, in order."""
    keep = corpus.select("sid", "url", "title", "site" if "site" in corpus.columns else urls.domain(F.col("url")).alias("site"), "engines", "published", "status", F.length("content").alias("char_count"), F.substring("snippet", 1, 300).alias("snippet"))
    q = quotes.groupBy("qid", "sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "quote"))), lambda x: x["quote"]).alias("quotes"))
    sources = scored.join(keep, "sid").join(q, ["qid", "sid"], "left")
    source = F.struct("idx", "sid", "url", "title", "site", "engines", "published", "status", "char_count", "snippet", *[F.round(c, 3).alias(c) for c in ("relevance", "authority", "freshness", "depth", "score")], F.slice(F.coalesce("quotes", F.array().cast("array<string>")), 1, 5).alias("quotes"))

    def listed(df: DataFrame, *columns: str, name: str) -> DataFrame:
        return df.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    parts = [
        sources.groupBy("qid").agg(F.array_sort(F.collect_list(source)).alias("sources")), listed(summary, "pos", "text", "source_idx", "score", "opposition", name="summary"), listed(divergences, "idx", "shared_terms", "text_a", "source_a", "text_b", "source_b", name="divergences"),
        listed(facets, "ord", "facet", "hits", name="facet_coverage"), listed(plan, "round", "ord", "text", "facet", "reason", "weight", name="plan"), coverage.select("qid", F.struct(*[c for c in coverage.columns if c != "qid"]).alias("coverage")),
    ]
    out = questions.select("qid", "query", "intent")
    for p in parts:
        out = out.join(p, "qid", "left")
    out = out.withColumn("gaps", F.transform(F.filter("facet_coverage", lambda x: x["hits"] == 0), lambda x: x["facet"]))
    return out.select("qid", F.struct(*[c for c in out.columns if c != "qid"]).alias("bundle"))


def warnings_of(sources: DataFrame, gaps: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(qid, kind, n): no text at all; most texts thin; facets without evidence; pages that robots.txt keeps."""
    own = sources.groupBy("qid").agg(F.count_if((F.col("status") == "ok") & (F.col("chars") >= 200)).alias("full"), F.count_if((F.col("status") == "ok") & F.col("chars").between(200, 799)).alias("thin"))
    rows = own.where("full = 0").select("qid", F.lit("no_content").alias("kind"), F.lit(0).cast("long").alias("n"))
    rows = rows.unionByName(own.where("full > 0 AND thin > full * 0.5").select("qid", F.lit("thin").alias("kind"), F.col("thin").alias("n")))
    rows = rows.unionByName(gaps.groupBy("qid").agg(F.lit("facet_gaps").alias("kind"), F.count(F.lit(1)).alias("n")))
    return rows if blocked is None else rows.unionByName(blocked.groupBy("qid").agg(F.lit("robots").alias("kind"), F.count(F.lit(1)).alias("n")))


def _seconds(s: float) -> str:
    return f"{s:.1f}s" if s < 60 else f"{int(s // 60)}m{int(s % 60)}s"


def as_json(bundle: dict) -> str:
    return json.dumps(bundle, ensure_ascii=False, indent=2)


def as_markdown(bundle: dict, with_sources: bool = True, with_summary: bool = True) -> str:
    """Numbered sections; empty ones are left out and do not count."""
    get = lambda k: bundle.get(k) or []
    cov = bundle.get("coverage") or {}
    sources = get("sources")
    sections: list[tuple[str, list[str]]] = []
    if with_summary:
        sections.append(("points", [f"- {s['text']} [{s['source_idx']}]" for s in get("summary")] or ["_未获得足够正文，无法生成要点。见下方来源列表。_"]))
    by_facet: dict[str, list[dict]] = {}
    for s in sources:
        for f in s.get("facets") or ["general"]:
            by_facet.setdefault(f, []).append(s)
    lines = []
    for f, own in sorted(by_facet.items(), key=lambda x: -len(x[1])):
        lines += [f"### {f}", *(f"- **{s.get('title', '')}** — {' '.join(((s.get('quotes') or [s.get('snippet', '')])[0] or '').split())[:240]} [{s.get('idx', 0)}]" for s in own[:4]), ""]
    sections.append(("facets", lines or ["_暂无分面证据。_"]))
    if get("divergences"):
        sections.append(("divergences", [x for d in get("divergences") for x in (f"- 围绕 **{'、'.join(d['shared_terms'][:5])}** 存在不同表述：", f"  - {d['text_a']} [{d['source_a']}]", f"  - {d['text_b']} [{d['source_b']}]")]))
    if get("gaps") or get("facet_coverage"):
        weak = [f["facet"] for f in get("facet_coverage") if f["hits"] == 0]
        told = [f"- {g}" for g in get("gaps")] + ([f"- 以下主题面在本轮证据中**没有命中**：{'、'.join(weak)}"] if weak else [])
        sections.append(("gaps", told or ["- 未发现明显缺口。"]))
    if with_sources:
        tail = lambda s: " ".join(x for x in (f"`{s['site']}`" if s.get("site") else "", s.get("published") or "", f"引擎:{'、'.join((s.get('engines') or [])[:3])}" if s.get("engines") else "", "" if s.get("status") == "ok" else s.get("status") or "") if x)
        sections.append(("sources", [f"{s.get('idx', 0)}. [{s.get('title') or s.get('url', '')}]({s.get('url', '')}) — {tail(s)}" for s in sources]))
    if stats := bundle.get("engine_stats"):
        good, bad = ([k for k, v in stats.items() if bool(v.get("hits")) is x] for x in (True, False))
        sections.append(("engines", [f"- 有效引擎 {len(good)} 个：{'、'.join(good) or '无'}", *([f"- 无结果引擎 {len(bad)} 个：{'、'.join(bad)}"] if bad else [])]))
    if get("warnings"):
        sections.append(("warnings", [f"- {w}" for w in get("warnings")]))
    meta = f"用时 {_seconds(bundle.get('elapsed_seconds', 0))} · 轮次 {len(get('rounds'))} · 来源 {cov.get('sources_with_content', 0)}/{cov.get('sources_total', 0)} 条有正文 · 独立域名 {cov.get('distinct_domains', 0)} · 正文合计 {cov.get('total_chars', 0):,} 字"
    out = [f"# 证据报告：{bundle.get('query', '')}\n", f"> {meta}\n", f"> 意图：`{bundle.get('intent', '')}`　生成于 {bundle.get('generated_at', '')}\n"]
    for n, (key, lines) in enumerate(sections):
        out += [f"\n## {NUMBERS[n] if n < len(NUMBERS) else n + 1}、{HEADINGS[key]}\n", *lines, ""]
    return "\n".join(out)


def as_brief(bundle: dict) -> str:
    cov = bundle.get("coverage") or {}
    head = [f"# {bundle.get('query', '')}", f"_{cov.get('sources_with_content', 0)} 条来源 · {cov.get('total_chars', 0):,} 字正文 · {_seconds(bundle.get('elapsed_seconds', 0))}_\n"]
    return "\n".join([*head, *(f"- {s['text']} [{s['source_idx']}]" for s in bundle.get("summary") or []), "\n## 来源", *(f"{s.get('idx', 0)}. [{s.get('title', '')}]({s.get('url', '')})" for s in bundle.get("sources") or [])])


def write_bundles(bundles: DataFrame, path: str) -> None:
    """All bundles as Parquet by question; as JSON lines besides."""
    bundles.write.mode("overwrite").parquet(f"{path}/bundles")
    bundles.select(F.to_json("bundle").alias("value")).write.mode("overwrite").text(f"{path}/json")


def write_files(bundle: dict, texts: dict[int, str], folder: str) -> list[str]:
    """One question's files: bundle.json, report.md and a file for each source with text."""
    out = Path(folder)
    (out / "sources").mkdir(parents=True, exist_ok=True)
    files = {out / "bundle.json": as_json(bundle), out / "report.md": as_markdown(bundle)}
    for s in bundle.get("sources") or []:
        if len(body := texts.get(s["sid"], "")) >= 200 and s.get("status") == "ok":
            name = re.sub(r"[^\w\-.]+", "_", s.get("title") or s.get("site") or "source")[:60]
            files[out / "sources" / f"{s['idx']:02d}_{name}.md"] = f"# {s.get('title', '')}\n\n- URL: {s.get('url', '')}\n- 站点: {s.get('site', '')}\n- 日期: {s.get('published', '')}\n- 综合分: {s.get('score', 0):.3f}\n\n---\n\n{body}"
    for path, body in files.items():
        path.write_text(body, "utf-8")
    return [str(p) for p in files]


