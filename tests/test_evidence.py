"""Behaviour of the evidence engine on small texts of our own."""

from __future__ import annotations

import math

import gzip
import json
import sys
import zlib
from urllib.parse import parse_qs, quote, quote_plus, urlsplit

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleaner import cli
from gleaner.functions import fixed, html, text, urls
from gleaner.operators import evidence as ev
from gleaner.operators import planning, selection
from gleaner.plans import report, session
from gleaner.sources import connectors, fetch
from gleaner.streaming import seen

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests

SERP = """<html><body><nav id="menu"><a href="https://site.example.com/start">主页 navigation link text</a></nav><ol id="b_results">
<li class="b_algo"><h2><a href="https://alpha.example.com/battery">Solid state batteries, explained</a></h2><div class="b_caption"><p>What the cells are made of and why the electrolyte matters so much.</p></div></li>
<li class="b_algo"><h2><a href="https://www.bing.com/ck/a?!&amp;&amp;p=1&amp;u=a1aHR0cHM6Ly9iZXRhLmV4YW1wbGUub3JnL2xpbmVz&amp;ntb=1">Production lines: a long report</a></h2><div class="b_caption"><p>Pilot lines started in several places, the report says, and costs fall.</p></div></li>
</ol><footer class="footer"><a href="https://site.example.com/imprint">The imprint of this very site</a></footer></body></html>"""
BODY = "The electrolyte of a solid cell is a ceramic. It keeps lithium in place, and it does not burn. " * 4
ARTICLE = f"""<!DOCTYPE html><html lang="zh-CN"><head><meta charset="utf-8"><meta property="og:title" content="固态电池的进展"><meta property="article:published_time" content="2025-6-7T10:00:00+08:00"><meta name="author" content="Ann  Lee"><title>x</title></head>
<body><nav><a href="/a">Navigation</a></nav><div class="sidebar"><a href="/b">相关推荐 something</a></div><article><h1>固态电池的进展</h1><p>{BODY}</p><p>产业化正在加速，多家企业公布了中试线的数据，能量密度也在提高，而成本正在下降。</p><p>short</p></article><footer>Footer text</footer><script>var hidden = "secret";</script></body></html>"""


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


# ---- pages ------------------------------------------------------------------------------------------------------------


def test_selectors():
    p = html.Page(SERP)
    texts = lambda s: [p.text(k) for k in html.select(p, s)]
    assert len(html.select(p, "li.b_algo")) == 2 == len(html.select(p, "#b_results > li"))
    assert texts("li h2 a") == ["Solid state batteries, explained", "Production lines: a long report"] == texts("ol#b_results h2 > a:hover")
    assert html.select(p, "h2 > p") == [] and len(html.select(p, "a[href^='https://site']")) == 2 == len(html.select(p, "nav a, footer a"))
    assert len(html.select(p, "[class~=b_algo]")) == 2 and html.select(p, "[class|=b]") == [] and len(html.select(p, "a[href$=imprint]")) == 1 == len(html.select(p, "a[href*='alpha']"))
    assert html.first(p, [".none", "footer"]) is not None and html.first(p, ".none") is None


def test_tolerant_parser():
    p = html.Page("<div><p>one<p>two<li>a<li>b<br>c</div><svg/>after<td>x<th>y <script>var a = '<p>no</p>'</script> end")
    assert [p.text(k) for k in html.select(p, "p")][0] == "one" and "no" not in p.text(0) and p.text(0).endswith("end") and "after" in p.text(0)
    for broken in ("", "<", "<<<>>>", "</p></div>", "<a href='x", "<!--", "&#xZZ;", None):
        html.Page(broken)


def test_node_table(spark):
    source = "<div class='x'>one<p>two <b>three</b></p><br></div><p>four</p>"
    p = html.Page(source)
    assert [p.text(k) for k in p.named("p")] == ["two three", "four"] and p.named("p", p.named("p")[0]) == [] and [p.depth(k) for k in p.named("b")] == [3]
    rows = spark.createDataFrame([(source,), (None,)], "html string").select(F.posexplode(html.nodes()("html")).alias("k", "n")).select("n.*").collect()
    got = [(r["node"], r["parent"], r["depth"], r["tag"], r["text"]) for r in rows]
    assert got[:6] == [(0, -1, 0, "#document", "one two three four"), (1, 0, 1, "div", "one two three"), (2, 1, 2, "p", "two three"), (3, 2, 3, "b", "three"), (4, 1, 2, "br", ""), (5, 0, 1, "p", "four")]
    assert got[6:] == [(0, -1, 0, "#document", "")] and rows[1]["attrs"] == {"class": "x"}


def test_removed_nodes_leave_the_text():
    p = html.Page("<div>a<nav>b<i>c</i></nav>d<i>e</i></div><p>f</p>")
    p.gone.update([*p.named("nav"), *p.named("i")])
    assert p.text(0) == "a d f" and p.text(1) == "a d" and p.layout(1) == "ad"


def test_article():
    a = html.article(ARTICLE, "https://x.example.com", 2026)
    assert (a.title, a.published, a.author, a.lang, a.extractor) == ("固态电池的进展", "2025-06-07", "Ann Lee", "zh-CN", "semantic")
    assert "Footer" not in a.text and "Navigation" not in a.text and "secret" not in a.text and not a.text.startswith("固态电池的进展")
    assert len(a.paragraphs) == 2 and a.char_count == len(a.text) == a.word_count
    assert html.article("", "u").extractor == "empty" == html.article(None).extractor
    plain = html.article(f"<html><body><div class='post'><p>{BODY}</p><p>{BODY}</p></div><div class='comment'>{'x ' * 30}</div></body></html>")
    assert plain.extractor == "readability-lite" and "x x" not in plain.text and plain.lang == "en"
    assert html.article(f"<html><body>{'word ' * 30}</body></html>").extractor == "body-fallback"
    assert html.article(ARTICLE.replace("2025-6-7", "1999-6-7"), "", 2026).published == ""


def test_snippets():
    s = html.snippet("filler " * 100 + "the solid electrolyte is here " + "tail " * 100, ["electrolyte", "solid"], 80)
    assert "electrolyte" in s and s.startswith("…") and s.endswith("…") and len(s) <= 84
    assert html.snippet("abc", []) == "abc" and html.snippet("", ["a"]) == ""


def test_result_pages(spark):
    hits = html.bing_results(SERP)
    assert [h["url"] for h in hits] == ["https://alpha.example.com/battery", "https://beta.example.org/lines"] and hits[0]["snippet"].startswith("What the cells")
    other = html.results(SERP, ("beta.example.org",))
    assert [h["title"] for h in other] == ["Solid state batteries, explained"] and other[0]["position"] == 1
    box = "".join(f'<div class="result" mu="https://r{k}.example.com/p"><h3><a href="http://www.baidu.com/link?url=z">Result number {k}</a></h3><div class="c-abstract">Abstract of the result {k}, which is long.</div></div>' for k in range(3))
    assert [h["url"] for h in html.baidu_results(f'<div id="content_left">{box}</div>', 2)] == ["https://r0.example.com/p", "https://r1.example.com/p"]
    got = connectors.parse_all(spark.createDataFrame([(1, "bing_intl", "q", SERP), (1, "ghost", "q", SERP)], "qid int, engine_id string, query string, body string")).collect()
    assert {r["engine_id"] for r in got} == {"bing_intl"} and len(got) == 2


# ---- text and addresses -----------------------------------------------------------------------------------------------


def test_tokens(spark):
    assert one(spark, text.tokenize, "固态电池 and the Node.js v2") == ["固态", "态电", "电池", "node.js", "v2"] == planning.tokens("固态电池 and the Node.js v2")
    assert one(spark, text.tokenize, None) == [] and one(spark, text.tokenize, "电池 a of") == ["电池"]
    assert one(spark, text.sentences, "第一句话在这里呢。第二句话也在这里! Third one is here. Next one too\nline") == ["第一句话在这里呢。", "第二句话也在这里!", "Third one is here.", "Next one too"]


def test_fingerprints(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta " * 9), (2, "alpha beta gamma delta " * 9), (3, "entirely other words are used here"), (4, "")], "id int, t string")
    f = {r["id"]: r["fingerprint"] for r in ev.simhash(docs, "id", text.content_tokens(F.col("t"))).collect()}
    assert f[1] == f[2] != f[3] and f[4] == 0
    assert spark.range(1).select(text.hamming(F.lit(5), F.lit(6))).first()[0] == 2


def test_near_pairs_same_as_brute_force(spark):
    import random

    rng = random.Random(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(64) for _ in range(60)]
    every = {signed(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 9)))) for b in base for _ in range(4)}
    want = {(a, b) for a in every for b in every if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 6}
    got = ev.near_pairs(spark.createDataFrame([(x,) for x in every], "fingerprint long")).collect()
    assert {(r["a"], r["b"]) for r in got} == want and want


def test_near_pairs_come_once(spark):
    """Each pair once, with its columns, and without gathering candidates: the driver and disks never see more than keys and pairs."""
    import random

    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    every = sorted({signed(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4)))) for b in [rng.getrandbits(64) for _ in range(9)] for _ in range(12)})
    prints = spark.createDataFrame([(x, f"n{i}") for i, x in enumerate(every)], "fingerprint long, name string")
    for distance, equal in ((6, 3), (4, 2), (1, 1)):
        want = sorted((a, b, f"n{i}", f"n{j}", d) for i, a in enumerate(every) for j, b in enumerate(every) if i < j and (d := ((a ^ b) & (1 << 64) - 1).bit_count()) <= distance)
        pairs = ev.near_pairs(prints, distance, equal)
        assert sorted(tuple(r) for r in pairs.select("a", "b", "a_name", "b_name", "distance").collect()) == want and want
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and plan.count("Join") == 1


def test_near_dup_pairs_same_as_sql_on_odd_rows(spark, tmp_path):
    """Rows without doc_id, repeated doc_ids, texts without tokens, one text often."""
    import duckdb

    from gleaner.plans import catalog

    long = " ".join(f"word{i} term{i % 7}" for i in range(60))
    docs = [(None, long + " beta beta gamma"), (1, long), (2, long + " alpha"), (2, "gamma"), (3, long), (4, ""), (5, None), (6, "the of 12"), (7, long + " delta delta")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("near_dup_pairs", "simhash_documents"):
        got, want = catalog.QUERIES[name](spark, str(tmp_path)), con.execute(catalog.SQL[name]).fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 2
    plan = catalog.QUERIES["near_dup_pairs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # of fingerprints with fingerprints; no pairs with documents


def test_addresses(spark):
    n = lambda u: one(spark, urls.normalize, u)
    assert n("http://www.Example.com/a/b/?utm_source=x&id=2#top") == "https://example.com/a/b?id=2" and n("https://example.com") == "https://example.com/" and n("") == ""
    for u in ("http://www.m.x.org:8080/p//?b=1&a=2", "https://x.org/?q=a+b&z=%E4%B8%AD", "ftp://x.org/f"):
        assert n(n(u)) == n(u)
    assert one(spark, urls.key, "http://www.x.org/") == one(spark, urls.key, "https://x.org") and one(spark, urls.domain, "https://user@WAP.x.org:1/p") == "x.org"
    ok = lambda u: one(spark, urls.holds_content, u)
    assert ok("https://x.org/a") and not ok("https://x.org/login") and not ok("javascript:void(0)") and not ok(None)
    wrapped = "https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9iZXRhLmV4YW1wbGUub3JnL2xpbmVz"
    assert one(spark, urls.unwrap, wrapped) == "https://beta.example.org/lines" == html.unwrap(wrapped) and one(spark, urls.unwrap, "https://a.b/") == "https://a.b/"


def test_term_discovery(spark):
    texts = [(1, x) for x in ("全固态电池产业化", "条固态电池中试线", "多固态电池技术", "某固态电池产能", "新固态电池路线")]
    found = {r["term"] for r in ev.discover_terms(spark.createDataFrame(texts, "qid int, text string")).collect()}
    assert "固态电池" in found and "态电池" not in found
    df = spark.createDataFrame([(1, "electrolyte research, electrolyte cost")] + texts, "qid long, text string")
    terms = planning.salient_terms(df, spark.createDataFrame([(1, "cost")], "qid long, query string")).first()["terms"]
    assert "固态电池" in terms and "electrolyte" in terms and "cost" not in terms


# ---- ranking ----------------------------------------------------------------------------------------------------------


def test_authority(spark):
    df = spark.createDataFrame([(d,) for d in ("arxiv.org", "export.arxiv.org", "city.gov", "content9.net", "unknown.xyz", "")], "domain string")
    v = {r["domain"]: round(r["authority"], 4) for r in ev.authority(df).collect()}
    assert v == {"arxiv.org": 0.97, "export.arxiv.org": 0.9215, "city.gov": 0.95, "content9.net": 0.25, "unknown.xyz": 0.55, "": 0.4}


SOURCES = "qid long, sid long, url string, title string, content string, snippet string, engines array<string>, queries array<string>, facets array<string>, status string, published string"


def source(sid, url, title, content, engines=("a",), snippet="s", qid=1):
    return (qid, sid, url, title, content, snippet, list(engines), ["q"], ["general"], "ok", "")


def test_scores(spark):
    rows = [source(1, "https://arxiv.org/1", "Solid battery", "Solid battery research. " * 50, ("a", "b")), source(2, "https://x.xyz/2", "Cooking", "How to cook pasta at home. " * 50), source(3, "https://x.xyz/3", "Battery", "One battery line. " * 5)]
    df, q = spark.createDataFrame(rows, SOURCES), spark.createDataFrame([(1, "solid battery")], "qid long, query string")
    got = {r["sid"]: r for r in ev.score_sources(df, df.select("qid", "sid"), q, 2026).collect()}
    assert [got[k]["idx"] for k in (1, 3, 2)] == [1, 2, 3] and got[1]["relevance"] == 1.0 and got[2]["bm25"] == 0.0 and got[1]["corroboration"] == 1.0
    heavy = {r["sid"]: r["score"] for r in ev.score_sources(df, df.select("qid", "sid"), q, 2026, {"authority": 9.0}).collect()}
    assert heavy[1] > got[1]["score"]


def test_dedupe(spark):
    long_a, long_b = "Alpha beta gamma delta epsilon zeta. " * 20, "Quite another text about other things. " * 15
    rows = [
        source(1, "http://www.x.org/a?utm_source=z", "The first title here", long_a, ("a",)), source(2, "https://x.org/a", "Another", long_a[:300], ("b",), ""), source(3, "https://y.org/copy", "The first title here", long_a, ("c",)),
        source(4, "https://y.org/near", "A headline about costs", long_b, ("d",)), source(5, "https://z.org/near", "A headline about costs!", long_b[:450] + "plus more words that differ a lot " * 9, ("e",)), source(6, "https://w.org/", "A headline about costs", "", ("f",)),
    ]
    got = {r["sid"]: r for r in selection.dedupe(spark.createDataFrame(rows, SOURCES)).collect()}
    assert got[2]["kept_sid"] == 1 and got[3]["merged"] != got[1]["merged"] and len({got[4]["kept_sid"], got[5]["kept_sid"]}) == 1 and not got[6]["merged"]
    kept = next(r for r in got.values() if r["sid"] == r["kept_sid"] and "b" in r["engines"])
    assert set(kept["engines"]) == {"a", "b", "c"}


def test_similarity():
    assert selection.similarity("", "a") == 0.0 and selection.similarity("same", "same") == 1.0 and selection.similarity("a b c solid", "solid") > 0.3


def test_summary_quotes_and_divergences(spark):
    good = "Solid state batteries reach high energy density in cells of 2025. " + "Pilot production lines started in many places this spring. " * 5
    rows = [source(1, "https://x.org/1", "Solid", good), source(2, "https://y.org/2", "State", "However solid state batteries fail to reach energy density in cells. " + "Other matters take the rest of this text, which is long. " * 4)]
    df = spark.createDataFrame(rows, SOURCES).withColumn("score", F.lit(0.5)).withColumn("idx", F.col("sid").cast("int"))
    q = spark.createDataFrame([(1, "solid state batteries")], "qid long, query string")
    summary = selection.extractive_summary(df, q, 4)
    got = summary.orderBy("pos").collect()
    content = {r[1]: r[4] for r in rows}
    assert all(r["text"] in content[r["sid"]] for r in got) and len({r["text"] for r in got}) == len(got) and {r["source_idx"] for r in got} == {1, 2}
    quotes = selection.select_quotes(df, q).where("sid = 1").orderBy("pos").collect()
    assert quotes[0]["quote"].startswith("Solid state batteries") and len({r["quote"] for r in quotes}) == len(quotes)
    d = ev.divergences(summary, 2).collect()
    assert len(d) == 1 and {d[0]["source_a"], d[0]["source_b"]} == {1, 2}
    assert ev.divergences(summary.where("source_idx = 1")).count() == 0


def test_mmr_prefers_new():
    pool = [(3.0, "a", {"x", "y"}), (2.9, "b", {"x", "y"}), (1.0, "c", {"z"}), (-1.0, "d", {"w"})]
    assert selection.most_relevant(pool, 3) == [0, 2]


# ---- planning ---------------------------------------------------------------------------------------------------------


def test_subjects(spark):
    s = lambda q: one(spark, planning.subject, q)
    assert s("请问固态电池的优缺点是什么？") in ("固态电池", "固态电池的优缺点是什么") and s("what is graph theory?") == "graph theory" and s("RAG 的局限") == "RAG" and s("什么是") == "什么是"


def test_plans():
    plan = planning.plan_one("RAG 的局限", "RAG", "tech")
    assert plan[0][:2] == ("RAG 的局限", "original") and len(plan) == 5 and len({p[0] for p in plan}) == 5 and plan[1][1] != "risk"
    assert planning.plan_one("site:x.org test", "test", "advanced") == [("site:x.org test", "original", "原始问题", 1, 1.0)] and planning.plan_one(" ", "", "general") == []
    own = planning.plan_one("q one two", "q", "general", 2, ["alpha beta", "alpha beta", "gamma delta", "epsilon"])
    assert [p[0] for p in own] == ["q one two", "alpha beta", "gamma delta"]
    more = planning.follow_one("RAG", [p[0] for p in plan], ["risk", "data"], ["vector index", "RAG"], 2, 4, ["latency"])
    assert [m[1] for m in more] == ["risk", "data", "entity", "counter"] and not {m[0] for m in more} & {p[0] for p in plan}


def test_coverage_and_gaps(spark):
    texts = spark.createDataFrame([(1, "The definition refers to a pipeline."), (1, "limitation and risk")], "qid long, text string")
    c = ev.facet_coverage(texts)
    hits = {r["facet"]: r["hits"] for r in c.collect()}
    assert hits["definition"] == 2 and hits["risk"] == 2 and hits["mechanism"] == 1 and hits["data"] == 0 and len(hits) == 10
    gaps = ev.empty_facets(c, spark.createDataFrame([(1, "finance")], "qid long, intent string")).orderBy("pos").collect()
    assert [g["facet"] for g in gaps][:3] == ["data", "status", "expert"]


def test_engines(spark):
    assert ev.engines_table(spark).count() == len(fixed.ENGINES) >= 12
    q = spark.createDataFrame([(1, "论文 综述", None, [], []), (2, "hello", None, ["github"], ["bing_cn", "bing_intl", "baidu", "so360", "github"])], "qid int, query string, hint string, include array<string>, exclude array<string>")
    got = {}
    for r in ev.route(q).orderBy("qid", "pos").collect():
        got.setdefault(r["qid"], []).append(r["engine_id"])
    assert got == {1: fixed.INTENT_ENGINES["academic"], 2: ["bing_cn"]}


# ---- fetching ---------------------------------------------------------------------------------------------------------


def transport(url, headers, timeout):
    if url.endswith("/robots.txt"):
        return 200, {}, b"User-agent: *\nDisallow: /private"
    if "broken" in url:
        raise OSError("no route")
    if "busy" in url:
        return 503, {}, b""
    if "image" in url:
        return 200, {"content-type": "image/png"}, b"x"
    return 200, {"content-type": "text/html; charset=gb18030", "content-encoding": "gzip"}, gzip.compress(("页面 " + ARTICLE).encode("gb18030"))


def test_fetch_one():
    waits = []
    assert fetch.fetch_one("https://x.org/a", 1, transport)["body"].startswith("页面")
    busy = fetch.fetch_one("https://x.org/busy", 1, transport, retries=2, sleep=waits.append)
    assert busy["status"] == 503 and busy["attempts"] == 3 and len(waits) == 2 and waits[1] > 1
    assert fetch.fetch_one("https://x.org/image", 1, transport)["error"] == "binary" and fetch.fetch_one("file:///etc/passwd", 1, transport)["error"] == "scheme"
    assert fetch.fetch_one("https://x.org/broken", 1, transport, retries=0)["error"] == "no route"


def test_bytes():
    assert fetch.decompress(zlib.compress(b"a" * 9), "deflate") == b"a" * 9 == fetch.decompress(zlib.compress(b"a" * 9)[2:-4], "deflate") and fetch.decompress(b"zz", "gzip") == b"zz"
    assert fetch.decode("中文".encode("gb18030")) == "中文" and fetch.decode(b'<meta charset="big5">' + "中文".encode("big5")).endswith("中文") and fetch.decode(b"\xff", "text/html; charset=nonsense")


def test_fetch_rows(spark):
    rows = [(f"https://h{k % 2}.org/{p}", 1.0, True) for k, p in enumerate(("a", "b", "private/x", "image", "a2"))] + [("https://h0.org/a", 1.0, True)]
    got = {r["url"]: r["error"] for r in fetch.fetch(spark.createDataFrame(rows, "url string, timeout double, check_robots boolean"), transport, 0.0, 2).collect()}
    assert len(got) == 5 and got["https://h0.org/private/x"] == "robots" and got["https://h0.org/a"] == ""
    cache = spark.createDataFrame([("https://h0.org/a", 95.0, "new"), ("https://h0.org/a", 90.0, "old"), ("https://h1.org/b", 1.0, "stale")], "url string, ts double, body string")
    hit, miss = fetch.cached(spark.createDataFrame([("https://h0.org/a",), ("https://h1.org/b",)], "url string"), cache, 100.0, 20)
    assert [r["body"] for r in hit.collect()] == ["new"] and [r["url"] for r in miss.collect()] == ["https://h1.org/b"]


def test_fetch_json(spark):
    def answer(url, headers, timeout):
        assert headers["Accept"] == ("text/x" if url.endswith("own") else "application/json, text/plain, */*")
        return (500 if url.endswith("error") else 200), {"content-type": "application/json"}, b"no json" if url.endswith("broken") else b'{"a": [1, {"b": "x"}]}'

    rows = [(f"https://h.org/{p}", 1.0, False, {"Accept": "text/x"} if p == "own" else None) for p in ("good", "own", "broken")]
    got = fetch.fetch_json(spark.createDataFrame(rows, "url string, timeout double, check_robots boolean, headers map<string,string>"), answer, min_interval=0.0)
    found = {r["url"][14:]: r["b"] for r in got.select("url", F.variant_get("value", "$.a[1].b", "string").alias("b")).collect()}
    assert found == {"good": "x", "own": "x", "broken": None}


def test_data_source(spark):
    spark.dataSource.register(fetch.Addresses)
    got = spark.read.format("gleaner_urls").option("urls", "ftp://a/x\nfile:///b").load().collect()
    assert {r["error"] for r in got} == {"scheme"}


# ---- rounds, reports, command line ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def done(spark):
    q = spark.createDataFrame([(1, "固态电池 电解质"), (2, "solid state battery")], "qid long, query string")

    def engine(tasks):
        k = F.explode(F.sequence(F.lit(1), F.lit(3)))
        own = tasks.select("qid", "engine_id", F.col("sent").alias("query"), k.alias("position"))
        at = F.pmod(F.xxhash64("query", "position"), F.lit(9)).cast("string")
        return own.select("qid", "engine_id", "query", "position", F.concat(F.lit("Solid battery "), at).alias("title"), F.concat(F.lit("https://www.site"), at, F.lit(".org/p?utm_x=1")).alias("url"), F.lit("a solid battery snippet").alias("snippet"))

    def pages(addresses):
        body = F.concat(F.lit("<html><head><title>t</title></head><body><article><p>"), F.repeat(F.concat(F.col("url"), F.lit(" tells of a solid state battery 电解质 and its cost. ")), 8), F.lit("</p></article></body></html>"))
        return addresses.select("url", body.alias("html"))

    return session.search(spark, q, engine, pages, session.Config(max_rounds=2, fetch_top_k=5, max_sources=4))


def test_rounds(done):
    assert {r["round"] for r in done["plan"].select("round").distinct().collect()} == {1, 2}
    assert done["sources"].groupBy("qid", "url").count().where("count > 1").count() == 0
    assert done["scored"].groupBy("qid").agg(F.max("idx").alias("m"), F.count(F.lit(1)).alias("n")).where("m <> n OR n > 4").count() == 0
    assert {r["source_idx"] for r in done["summary"].collect()} <= {1, 2, 3, 4} and done["summary"].count() > 0


def test_no_fetch(spark):
    q = spark.createDataFrame([(1, "solid battery")], "qid long, query string")
    engine = lambda t: t.select("qid", "engine_id", F.col("sent").alias("query"), F.lit(1).alias("position"), F.lit("Title of it").alias("title"), F.lit("https://x.org/1").alias("url"), F.lit("snippet").alias("snippet"))
    got = session.search(spark, q, engine, None, session.Config(fetch_pages=False))
    assert got["scored"].count() == 1 and got["summary"].count() == 0 and {r["round"] for r in got["plan"].collect()} == {1}


def test_reports(spark, done, tmp_path):
    bundles = report.build_bundles(done["questions"], done["scored"], done["corpus"], done["summary"], done["quotes"], done["divergences"], done["coverage"], done["facets"], done["plan"])
    b = bundles.where("qid = 2").first()["bundle"].asDict(recursive=True)
    full, brief = report.as_markdown(b), report.as_brief(b)
    assert "[1]" in full and "## 一、" in full and "来源清单" in full and len(brief) < len(full) and json.loads(report.as_json(b))["query"] == "solid state battery"
    assert "来源清单" not in report.as_markdown(b, with_sources=False) and "注意事项" in report.as_markdown(b | {"warnings": ["w"]}) and "无结果引擎 1" in report.as_markdown(b | {"engine_stats": {"a": {"hits": 0}}})
    texts = {r["sid"]: r["content"] for r in done["corpus"].collect()}
    files = report.write_files(b, texts, str(tmp_path / "out"))
    assert len(files) == 2 + len(b["sources"]) and (tmp_path / "out" / "report.md").read_text("utf-8") == full
    report.write_bundles(bundles, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all" / "bundles")).count() == 2


def test_warnings(spark):
    s = spark.createDataFrame([(1, "ok", 300), (1, "ok", 900), (1, "ok", 250), (2, "empty", 0)], "qid long, status string, chars int")
    got = {(r["qid"], r["kind"]) for r in report.warnings_of(s, spark.createDataFrame([(1, "data")], "qid long, facet string")).collect()}
    assert got == {(1, "thin"), (1, "facet_gaps"), (2, "no_content")}


def test_config_and_command_line(tmp_path, capsys):
    path = tmp_path / "c.yaml"
    path.write_text("# comment\nsettings:\n  max_rounds: 3 # three\n  breadth: 2\n  unknown: x\nother: 'text'\n", "utf-8")
    assert session.read_config(path.read_text("utf-8")) == {"settings": {"max_rounds": 3, "breadth": 2, "unknown": "x"}, "other": "text"} and session.read_config("no") == {}
    c = cli.configured(cli.parser().parse_args(["q", "-c", str(path), "-b", "7"]))
    assert (c.max_rounds, c.breadth, c.max_sources) == (3, 7, 14)
    assert cli.main(["--list-engines"]) == 0 and cli.main(["--show-config"]) == 0 and cli.main([]) == 2
    assert "bing_cn" in capsys.readouterr().out


def test_command_line_over_a_corpus(spark, tmp_path, capsys):
    assert cli.main(["the of and that onesen", "--corpus", "/root/testdata/sf0.001", "-f", "brief", "-o", str(tmp_path)]) == 0
    assert "## 来源" in capsys.readouterr().out and (tmp_path / "bundle.json").exists()


# ---- streams ----------------------------------------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    rows = [(1, "http://www.x.org/a", "e1", "2024-01-01 00:00:00"), (1, "https://x.org/a?utm_x=1", "e2", "2024-01-01 00:05:00"), (2, "https://x.org/a", "e1", "2024-01-01 00:06:00")]
    spark.createDataFrame(rows, "qid int, url string, engine_id string, at string").select("qid", "url", "engine_id", F.to_timestamp("at").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("qid int, url string, engine_id string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("fresh", seen.new_addresses(stream()), "append"), ("active", seen.engine_activity(stream()), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("fresh").count() == 2 and {(r["engine_id"], r["hits"]) for r in spark.table("active").collect()} == {("e1", 2), ("e2", 1)}


def test_settings_of_all_sections():
    """Every section of a settings file reaches the run."""
    own = session.read_config("""
loop:
  max_rounds: 3   # more
  timeout: 9.5
  cache: false
  intent: null
  engines: [github, arxiv]
  exclude_engines: []
deduplication:
  title_similarity_threshold: 0.9
  fingerprint_hamming_distance: 4
  min_title_length: 8
ranking:
  relevance: 2.0
  authority: high
engine_weights:
  arxiv: 0.5
  bing_cn: null
""")
    c = session.Config.of_sections(own, {"breadth": 7, "timeout": None, "max_rounds": 1})
    assert (c.max_rounds, c.breadth, c.timeout, c.cache, c.intent, c.engines, c.exclude_engines) == (1, 7, 9.5, False, None, ("github", "arxiv"), ())
    assert (c.title_threshold, c.fingerprint_distance, c.weights, c.engine_weights) == (0.9, 4, {"relevance": 2.0}, {"arxiv": 0.5})
    assert session.Config.of_sections({}) == session.Config.of_sections({"ranking": "x", "deduplication": {"title_similarity_threshold": "y"}}) == session.Config()


def test_candidates_may_be_given(spark):
    """BM25 over given candidates counts those without a term; without candidates all sources with a term are the collection."""
    empty = ["", ["e"], "ok", ""]
    corpus = spark.createDataFrame([(1, "u", "alpha", "alpha beta beta", *empty), (2, "u", "gamma", "delta", *empty), (3, "u", "beta", "alpha", *empty)], "sid long, url string, title string, content string, snippet string, engines array<string>, status string, published string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "qid long, query string")
    given = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3)], "qid long, sid long")
    own = lambda c: {(r["qid"], r["sid"]): r["bm25"] for r in ev.bm25(corpus, c, q).collect()}
    free, chosen = own(None), own(given)
    assert set(free) == {(1, 1), (1, 3), (2, 2)} and set(chosen) == {(1, 1), (1, 2), (2, 2), (2, 3)}
    assert chosen[1, 2] == 0 == chosen[2, 3] and all(x > 0 for x in free.values())
    texts = {1: ["alpha"] * 3 + ["alpha", "beta", "beta"], 2: ["gamma"] * 3 + ["delta"]}
    average = (6 + 4) / 2

    def part(term, sid, n=2):
        f = texts[sid].count(term)
        return math.log(1 + (n - 1 + 0.5) / 1.5) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(texts[sid]) / average))

    assert math.isclose(chosen[1, 1], part("alpha", 1) + part("beta", 1), rel_tol=1e-12)


def test_addresses(spark):
    odd = "a b/c*d~e&f=+%ä中 {limit} {path}"
    tasks = spark.createDataFrame([(1, e[0], odd) for e in fixed.ENGINES] + [(2, "nobody", "x"), (3, "arxiv", "ti:x y"), (4, "brave", None), (5, "arxiv", " x y ")], "qid long, engine_id string, sent string")
    got = {(r["qid"], r["engine_id"]): r for r in connectors.addresses(tasks, 30).collect()}
    assert len(got) == len(fixed.ENGINES) + 3 and (2, "nobody") not in got
    assert got[1, "brave"]["url"].endswith("?q=" + quote(odd)) and got[4, "brave"]["url"].endswith("?q=") and got[1, "bing_cn"]["url"].split("?")[1] == f"q={quote(odd)}&ensearch=0&count=20"
    asked = {e: parse_qs(urlsplit(got[1, e]["url"]).query) for e in ("crossref", "github", "hackernews", "wikipedia_en")}
    assert asked["crossref"]["query"] == [odd] and asked["crossref"]["rows"] == ["30"] and f"query={quote_plus(odd)}&" in got[1, "crossref"]["url"]
    assert asked["github"]["per_page"] == ["20"] == asked["hackernews"]["hitsPerPage"] and asked["wikipedia_en"]["srprop"] == ["snippet|wordcount|timestamp"]
    assert "search_query=ti%3Ax+y&" in got[3, "arxiv"]["url"] and "search_query=all%3Ax+y&" in got[5, "arxiv"]["url"]
    assert got[1, "github"]["headers"] == {"Accept": "application/vnd.github+json"} and got[1, "brave"]["headers"] == {}


def service(url, headers, timeout):
    if "api.github.com" in url and headers.get("Accept", "").endswith("github+json"):
        return 200, {"content-type": "application/json"}, json.dumps({"items": [{"full_name": "a/b", "html_url": "https://github.com/a/b", "description": "tool"}]}).encode()
    if "cn.bing.com" in url:
        return 200, {"content-type": "text/html"}, SERP.encode()
    return 404, {}, b""


def test_ask(spark):
    tasks = spark.createDataFrame([(1, "github", "x", 1.0), (2, "github", "x", 1.0), (1, "bing_cn", "x", 1.0), (1, "brave", "x", 1.0)], "qid long, engine_id string, sent string, timeout double")
    hits = connectors.ask(tasks, session.stored, service, 8, 0.0).collect()
    assert sorted((r["qid"], r["engine_id"], r["url"]) for r in hits if r["engine_id"] == "github") == [(1, "github", "https://github.com/a/b"), (2, "github", "https://github.com/a/b")]
    assert [r["position"] for r in hits if r["engine_id"] == "bing_cn"] == [1, 2] and len(hits) == 4


def web(url, headers, timeout):
    if "bing.com/search" in url:
        return 200, {"content-type": "text/html"}, SERP.encode()
    if url.endswith("/robots.txt"):
        return 404, {}, b""
    if "example" in url:
        return 200, {"content-type": "text/html"}, f"<html><head><title>Cells</title></head><body><article><h1>Cells</h1><p>{BODY}</p><p>{BODY}</p></article></body></html>".encode()
    return 404, {}, b""


def test_command_line_asks_engines(spark, tmp_path):
    assert cli.main(["electrolyte of a solid cell", "-r", "1", "-b", "1", "--min-interval", "0", "-f", "json", "-o", str(tmp_path)], web) == 0
    found = json.loads((tmp_path / "bundle.json").read_text())
    assert found["sources"] and all("example" in s["url"] for s in found["sources"]) and found["summary"]
