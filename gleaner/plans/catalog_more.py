"""More registered queries: connectors on literal payloads, pages, sequential choices, bundles."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from ..functions import fixed, html, text
from ..operators import evidence as ev
from ..operators import planning, selection
from ..sources import connectors
from . import inputs as i
from . import report
from .catalog import _BEST, best_sources, query
from .store import stored

# ---- connectors -------------------------------------------------------------------------------------------------------

_PAYLOADS = {
    "wikipedia_en": {"query": {"search": [{"title": "Solid state", "snippet": "a <b>solid</b>  state", "wordcount": 120}, {"title": "Battery", "snippet": "cell &amp; pack, 5 &lt; 6 &#39;V&#39;"}]}},
    "crossref": {"message": {"items": [
        {"title": ["A paper"], "DOI": "10.1/x", "author": [{"given": "Ann", "family": "Lee"}, {"family": "Solo"}], "issued": {"date-parts": [[2021, 5]]}, "container-title": ["Journal"], "type": "article"},
        {"title": [], "DOI": "10.1/y"}, {"title": ["Second"], "URL": "https://example.org/2", "abstract": "<p>An  abstract &amp;amp; &lt;b&gt;more&lt;/b&gt;</p>", "issued": {"date-parts": [[None]]}},
    ]}},
    "openalex": {"results": [{"id": "https://openalex.org/W1", "title": "Graph", "publication_year": 2020, "authorships": [{"author": {"display_name": "B. C."}}], "primary_location": {"source": {"display_name": "Venue"}}, "abstract_inverted_index": {"deep": [1, 3], "We": [0], "nets": [2]}, "cited_by_count": 7}, {"id": "W2", "doi": "https://doi.org/10.2/z", "title": "No abstract", "primary_location": None}]},
    "github": {"items": [{"full_name": "a/b", "html_url": "https://github.com/a/b", "description": "tool &mdash; R&amp;D", "stargazers_count": 5, "language": "Python", "updated_at": "2024-05-06T00:00:00Z"}, {"full_name": "c/d", "html_url": "https://github.com/c/d", "description": None, "stargazers_count": 0, "language": None}]},
    "stackexchange": {"items": [{"title": "How?", "body": "<p>Do  this</p>", "link": "https://stackoverflow.com/q/1", "tags": ["a", "b"], "score": 3, "is_answered": True}, {"title": "How to use &quot;x&quot; &amp; y", "body": "<p>a &lt; b, caf&eacute;&#x21;</p>", "link": "https://stackoverflow.com/q/3", "tags": []}, {"title": "Why?", "body": "", "link": "https://stackoverflow.com/q/2", "tags": ["x", "y", "z"]}]},
    "hackernews": {"hits": [{"title": "Show &#20013;&nbsp;&#25991;", "url": "https://example.com/s", "points": 10, "num_comments": 2, "objectID": "1"}, {"title": None, "story_title": "Story", "url": None, "objectID": "42", "points": None, "num_comments": None}, {"title": "", "objectID": "3"}]},
}


_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x21;", "!"), ("&eacute;", "é"), ("&mdash;", "—"), ("&nbsp;", "\u00a0"), ("&#20013;", "中"), ("&#25991;", "文"), ("&amp;", "&")]


def _strip(x: str) -> str:
    """Entities that the payloads have, tags, white space (RE2's own and U+00A0), and spaces between CJK characters."""
    x = f"coalesce({x}, '')"
    for name, c in _ENTITIES:
        x = f"replace({x}, {i.lit(name)}, {i.lit(c)})"
    flat = i.sql_squeeze(f"replace(regexp_replace({x}, '<[^>]+>', '', 'g'), chr(160), ' ')")
    return f"regexp_replace({flat}, '([一-鿿]) ([一-鿿])', '\\1\\2', 'g')"


def _twice(x: str) -> str:
    """Some connectors clean a field before it is cut, so it is cleaned twice."""
    return _strip(_strip(x))


def _payload_sql(engine: str, path: str, title: str, url: str, snippet: str) -> str:
    body = json.dumps(_PAYLOADS[engine], ensure_ascii=False)
    return f"""WITH p AS (SELECT {i.lit(body)}::JSON AS body), x AS (SELECT unnest(from_json(body->'{path}', '["json"]')) AS it, unnest(range(1, json_array_length(body->'{path}')::BIGINT + 1))::INT AS position FROM p),
h AS (SELECT position, {(_twice if engine == "stackexchange" else _strip)(title)} AS title, coalesce({url}, '') AS url, {(_twice if engine in ("stackexchange", "crossref", "wikipedia_en") else _strip)(snippet)} AS snippet FROM x) SELECT * FROM h WHERE title <> '' AND url <> ''"""


def _connector(engine: str):
    def run(spark, sf_dir):
        rows = [(1, "q", json.dumps(_PAYLOADS[engine], ensure_ascii=False))]
        return connectors.parse(i.table(spark, "qid int, query string, body string", rows), engine).select("position", "title", "url", "snippet")

    run.__name__ = f"connector_{engine}"
    return run


def _get(path: str) -> str:
    return f"it->>'{path}'"


_VENUE_YEAR = f"trim(coalesce({_get('$.\"container-title\"[0]')}, '') || ' ' || coalesce({_get('$.issued.\"date-parts\"[0][0]')}, ''))"
_ABSTRACT = "(SELECT string_agg(w, ' ' ORDER BY p) FROM (SELECT unnest(json_keys(it->'abstract_inverted_index')) AS w), LATERAL (SELECT unnest(from_json(json_extract(it, '$.abstract_inverted_index.' || w), '[\"INT\"]')) AS p))"
query(_payload_sql("wikipedia_en", "$.query.search", _get("title"), f"'https://en.wikipedia.org/wiki/' || replace({_get('title')}, ' ', '_')", _get("snippet")))(_connector("wikipedia_en"))
query(_payload_sql("crossref", "$.message.items", _get("$.title[0]"), f"coalesce({_get('URL')}, 'https://doi.org/' || ({_get('DOI')}))", f"coalesce({_get('abstract')}, {_VENUE_YEAR})"))(_connector("crossref"))
query(_payload_sql("openalex", "$.results", _get("title"), f"coalesce({_get('doi')}, {_get('id')})", f"coalesce({_ABSTRACT}, {_get('$.primary_location.source.display_name')})"))(_connector("openalex"))
query(_payload_sql("github", "$.items", _get("full_name"), _get("html_url"), f"coalesce({_get('description')}, '') || ' ⭐' || ({_get('stargazers_count')}) || coalesce(' · ' || ({_get('language')}), '')"))(_connector("github"))
query(_payload_sql("stackexchange", "$.items", _get("title"), _get("link"), f"CASE WHEN {_get('body')} <> '' THEN {_get('body')} ELSE array_to_string(from_json(it->'tags', '[\"VARCHAR\"]'), ' ') END"))(_connector("stackexchange"))
query(_payload_sql("hackernews", "$.hits", f"coalesce({_get('title')}, {_get('story_title')})", f"coalesce({_get('url')}, 'https://news.ycombinator.com/item?id=' || ({_get('objectID')}))", f"coalesce({_get('points')}, '0') || ' points · ' || coalesce({_get('num_comments')}, '0') || ' comments'"))(_connector("hackernews"))

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1</id><title>Deep
 nets</title><summary> A  summary </summary><published>2023-04-05T00:00:00Z</published><author><name>A. One</name></author><author><name>B. Two</name></author><link href="http://arxiv.org/abs/1v1" rel="alternate"/><link title="pdf" href="http://arxiv.org/pdf/1v1" rel="related"/></entry><entry><id>http://arxiv.org/abs/2</id><title>Second</title><summary>s</summary><author><name>C</name></author></entry></feed>"""


@query("SELECT * FROM (VALUES (1, 'Deep nets', 'http://arxiv.org/abs/1v1', 'A summary', 'A. One,B. Two', '2023-04-05', 'http://arxiv.org/pdf/1v1'), (2, 'Second', 'http://arxiv.org/abs/2', 's', 'C', '', '')) AS t(position, title, url, snippet, authors, published, pdf)")
def connector_arxiv(spark, sf_dir):
    hits = connectors.arxiv(i.table(spark, "qid int, query string, body string", [(1, "q", ATOM)]))
    extra = F.from_json("extra", "authors array<string>, published string, pdf string")
    return hits.select("position", "title", "url", "snippet", extra.alias("x")).select("position", "title", "url", "snippet", F.array_join("x.authors", ",").alias("authors"), "x.published", "x.pdf")


_INDEX = [(1, {"the": [0, 4], "cat": [1], "sat": [2], "on": [3], "mat": [5]}), (2, {}), (3, {"x": [7], "y": [2]})]


@query("SELECT * FROM (VALUES (1, 'the cat sat on the mat'), (2, ''), (3, 'y x')) AS t(id, abstract)")
def openalex_abstract(spark, sf_dir):
    return i.table(spark, "id int, index map<string, array<int>>", _INDEX).select("id", connectors.abstract_text(F.col("index")).alias("abstract"))


# ---- pages ------------------------------------------------------------------------------------------------------------


@query()
def html_articles(spark, sf_dir):
    pages = i.read(spark, sf_dir, "pages").select("page_id", html.articles(i.NOW_YEAR)("html", "url").alias("a"))
    return pages.select("page_id", "a.title", "a.lang", "a.published", "a.extractor", "a.char_count", "a.word_count", F.size("a.paragraphs").alias("n_paragraphs"), F.md5("a.text").alias("text"))


@query()
def css_select(spark, sf_dir):
    pages = i.read(spark, sf_dir, "pages").select("page_id", F.posexplode(html.selected("nav li > a[href^='/'], article h1, div.ad")("html")).alias("pos", "n"))
    return pages.select("page_id", "pos", "n.tag", F.col("n.attrs")["href"].alias("href"), "n.text")


@query()
def html_nodes(spark, sf_dir):
    """The pages as one node table."""
    pages = i.read(spark, sf_dir, "pages").select("page_id", F.explode(html.nodes()("html")).alias("n"))
    return pages.select("page_id", "n.node", "n.parent", "n.depth", "n.tag", F.col("n.attrs")["class"].alias("class"), F.md5("n.text").alias("text"))


RESULT_PAGE = """<html><body><div id="nav"><a href="https://x.example.com/">首页</a></div><ol id="b_results"><li class="b_algo"><h2><a href="https://example.com/a?x=1">A good headline: part one</a></h2><div class="b_caption"><p>A snippet that says what the page is about, in some words.</p></div></li>
<li class="b_algo"><h2><a href="https://www.bing.com/ck/a?!&amp;u=a1aHR0cHM6Ly9leGFtcGxlLm9yZy9i">Second headline of the list</a></h2><div class="b_caption"><p>Another snippet, again with a number of words in it.</p></div></li></ol><footer><a href="https://example.net/privacy">Privacy policy of the site</a></footer></body></html>"""


@query()
def serp_generic(spark, sf_dir):
    rows = [(1, e, "q", RESULT_PAGE) for e in ("bing_cn", "brave", "baidu", "nobody")]
    return connectors.parse_all(i.table(spark, "qid int, engine_id string, query string, body string", rows)).select("engine_id", "position", "title", "url", "snippet")


@query()
def make_snippet(spark, sf_dir):
    def cut(batches):
        for pdf in batches:
            yield pd.DataFrame({"sid": pdf.sid, "snippet": [html.snippet(x, list(t)) for x, t in zip(pdf.content, pdf.terms, strict=True)]})

    docs = i.corpus(spark, sf_dir).select("sid", "content", F.slice(text.content_tokens(F.col("title")), 1, 3).alias("terms"))
    return docs.mapInPandas(cut, "sid long, snippet string")


# ---- sequential choices -----------------------------------------------------------------------------------------------


def _sources(spark, sf_dir):
    """The best sources of each question, as the last round leaves them."""
    empty = F.array().cast("array<string>")
    return best_sources(spark, sf_dir).withColumns({"queries": empty, "facets": empty}).withColumn("qid", F.col("qid").cast("long"))


@query()
def dedupe_sources(spark, sf_dir):
    return selection.dedupe(_sources(spark, sf_dir)).select("qid", "sid", "kept_sid", "merged", F.array_join("engines", ",").alias("engines"))


@query()
def extractive_summary(spark, sf_dir):
    return selection.extractive_summary(_sources(spark, sf_dir), i.questions(spark, sf_dir))


@query()
def select_quotes(spark, sf_dir):
    return selection.select_quotes(_sources(spark, sf_dir), i.questions(spark, sf_dir))


def _asked(spark):
    return i.table(spark, "qid long, query string, hint string", i.QUESTION_ROWS).select("qid", "query", ev.intent(F.col("query"), F.col("hint")).alias("intent"))


@query()
def plan_subqueries(spark, sf_dir):
    return planning.plan(_asked(spark))


@query()
def plan_benchmark(spark, sf_dir):
    return planning.plan(i.questions(spark, sf_dir).withColumn("intent", ev.intent(F.col("query"))))


@query(_BEST + f""", w AS (SELECT qid, unnest(l) AS term, unnest(range(len(l))) AS p FROM (SELECT qid, list_transform(regexp_extract_all(content, '{fixed.LATIN_WORD}'), lambda x: lower(x)) AS l FROM best)),
c AS (SELECT qid, term, count(*) AS times, min(p) AS first FROM w WHERE length(term) >= 4 AND NOT list_contains({i.STOP}, term) GROUP BY ALL), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY times DESC, first, term) <= 6),
own AS (SELECT DISTINCT qid, unnest({i.sql_tokens('query')}) AS term FROM questions), k AS (SELECT f.* FROM f ANTI JOIN own ON f.qid = own.qid AND f.term = own.term WHERE times >= 2)
SELECT qid, string_agg(term, ',' ORDER BY length(term) DESC, times DESC, term) AS terms FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.qid = k.qid AND o.term <> k.term AND contains(o.term, k.term)) GROUP BY qid""")
def salient_terms(spark, sf_dir):
    """The SQL is that of texts without CJK runs, as all of the tables' are; terms of such runs are discover_terms'."""
    q = i.questions(spark, sf_dir)
    found = planning.salient_terms(_sources(spark, sf_dir).select("qid", F.col("content").alias("text")), q)
    return found.select("qid", F.array_join("terms", ",").alias("terms"))


@query()
def follow_up(spark, sf_dir):
    q = _asked(spark)
    plan = planning.plan(q).groupBy("qid").agg(F.array_sort(F.collect_list("text")).alias("asked"))
    cover = ev.facet_coverage(q.select("qid", F.col("query").alias("text")))
    gaps = ev.empty_facets(cover, q.select("qid", "intent")).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "facet"))), lambda x: x["facet"]).alias("gaps"))
    state = q.join(plan, "qid").join(gaps, "qid").withColumns({"terms": F.array(F.lit("固态"), F.lit("energy")), "disputes": F.array(F.lit("cost"))})
    return planning.follow_up(state, 2)


@query()
def evidence_bundle(spark, sf_dir):
    corpus, q = i.corpus(spark, sf_dir), i.questions(spark, sf_dir).withColumn("intent", ev.intent(F.col("query")))
    scored = stored(ev.score_sources(corpus, None, q, i.NOW_YEAR).where(F.col("idx") <= fixed.DEFAULTS["max_sources"]), "scored")
    best = stored(scored.select("qid", "sid", "idx", "score").join(corpus, "sid"), "best")  # max_sources rows for each question
    summary = stored(selection.extractive_summary(best, q), "summary")
    full = best.where(F.length("content") >= 200).withColumnRenamed("content", "text")
    bundles = report.build_bundles(q, scored, corpus, summary, selection.select_quotes(best, q), ev.divergences(summary), ev.coverage_report(best, i.NOW_YEAR), ev.facet_coverage(full), planning.plan(q))
    return bundles.select("qid", F.to_json("bundle").alias("bundle"))
