"""Connectors: payloads of search services to hits. Fetching and parsing are apart: parsers are Column expressions over
payloads(qid, query, body) and run anywhere; fetching is in fetch.py and needs a transport."""

from __future__ import annotations

from collections.abc import Callable
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, html, text, urls
from . import fetch

_ENGINE = {e[0]: e for e in fixed.ENGINES}


def _text(c) -> Column:
    return F.coalesce(c, F.lit(""))


@F.pandas_udf(T.StringType())
def _unescaped(c: pd.Series) -> pd.Series:
    return c.map(unescape)


def cleaned(c: Column) -> Column:
    """Entities become characters (all names that HTML has, and numbers), then tags and surplus white space go."""
    return text.clean_markup(_unescaped(_text(c)))


def _hits(payloads: DataFrame, engine_id: str, items: Column, make, limit: int) -> DataFrame:
    """make(item) gives title, url, snippet and extra. Where it gives `otherwise`, the snippet is cleaned (and cut to `cut`) before
    all else, and `otherwise` stands in for an empty one; titles are cleaned once more where `again` is given."""
    e = _ENGINE[engine_id]
    each = payloads.select("qid", "query", F.posexplode(F.slice(F.coalesce(items, F.array()), 1, limit)).alias("p", "it"))
    parts = make(F.col("it"))
    raw = F.struct(*[_text(parts[c]).alias(c) for c in ("title", "url", "snippet")], F.to_json(parts["extra"]).alias("extra"), _text(parts.get("otherwise", F.lit(""))).alias("otherwise"))
    own = each.select("qid", "query", (F.col("p") + 1).alias("position"), F.inline(F.array(raw)))
    title, snippet = cleaned(F.col("title")), F.col("snippet")
    if "again" in parts:
        title = cleaned(title)
    if "otherwise" in parts:
        first = F.substring(cleaned(snippet), 1, parts.get("cut", 1 << 30))
        snippet = F.when(first != "", first).otherwise(F.col("otherwise"))
    own = own.select(
        "qid", F.lit(engine_id).alias("engine_id"), F.lit(e[2]).alias("category"), F.lit(e[3]).alias("weight"), "query", "position", F.substring(title, 1, 300).alias("title"),
        F.substring(urls.unwrap(F.trim("url")), 1, 900).alias("url"), F.substring(cleaned(snippet), 1, 600).alias("snippet"), "extra",
    )
    return own.where((F.col("title") != "") & (F.col("url") != ""))


def _json(schema: str) -> Column:
    return F.from_json("body", schema)


def wikipedia(payloads: DataFrame, lang: str = "en", limit: int = 10) -> DataFrame:
    items = _json("query struct<search: array<struct<title: string, snippet: string, wordcount: int>>>")["query"]["search"]
    page = lambda t: F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"), F.replace(F.url_encode(F.replace(t, F.lit(" "), F.lit("_"))), F.lit("%2F"), F.lit("/")))
    return _hits(payloads, f"wikipedia_{lang}", items, lambda i: {"title": i["title"], "url": page(i["title"]), "snippet": i["snippet"], "otherwise": F.lit(""), "extra": F.struct(F.coalesce(i["wordcount"], F.lit(0)).alias("wordcount"))}, limit)


def crossref(payloads: DataFrame, limit: int = 10) -> DataFrame:
    schema = "message struct<items: array<struct<title: array<string>, DOI: string, URL: string, abstract: string, author: array<struct<given: string, family: string>>, issued: struct<`date-parts`: array<array<int>>>, `container-title`: array<string>, type: string>>>"

    def make(i):
        first = lambda a: _text(F.try_element_at(a, F.lit(1)))
        year = _text(F.try_element_at(F.try_element_at(i["issued"]["date-parts"], F.lit(1)), F.lit(1)).cast("string"))
        doi, venue = _text(i["DOI"]), first(i["container-title"])
        names = F.filter(F.transform(F.slice(F.coalesce(i["author"], F.array()), 1, 5), lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), lambda n: n != "")
        return {
            "title": first(i["title"]), "url": F.coalesce(i["URL"], F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi))), "snippet": i["abstract"], "otherwise": F.trim(F.concat_ws(" ", venue, year)),
            "extra": F.struct(doi.alias("doi"), year.alias("year"), names.alias("authors"), venue.alias("venue"), _text(i["type"]).alias("type")),
        }

    return _hits(payloads, "crossref", _json(schema)["message"]["items"], make, limit)


def abstract_text(index: Column) -> Column:
    """map<string, array<int>> of words and their places to the text; where places clash, the last word in the map stays."""
    entries = F.map_entries(index)
    places = F.flatten(F.transform(entries, lambda e, k: F.transform(e["value"], lambda p: F.struct(p.alias("p"), k.alias("k"), e["key"].alias("w")))))
    in_order = F.array_sort(F.coalesce(places, F.array().cast("array<struct<p:int,k:int,w:string>>")))
    last = F.filter(in_order, lambda x, n: (n == F.size(in_order) - 1) | (F.try_element_at(in_order, n + 2)["p"] != x["p"]))
    return F.array_join(F.transform(last, lambda x: x["w"]), " ")


def openalex(payloads: DataFrame, limit: int = 10) -> DataFrame:
    schema = "results array<struct<id: string, doi: string, title: string, publication_year: int, authorships: array<struct<author: struct<display_name: string>>>, primary_location: struct<source: struct<display_name: string>>, abstract_inverted_index: map<string, array<int>>, cited_by_count: int>>"

    def make(i):
        venue, abstract = _text(i["primary_location"]["source"]["display_name"]), abstract_text(i["abstract_inverted_index"])
        names = F.filter(F.transform(F.slice(F.coalesce(i["authorships"], F.array()), 1, 5), lambda a: _text(a["author"]["display_name"])), lambda n: n != "")
        return {"title": i["title"], "url": F.coalesce(i["doi"], i["id"]), "snippet": F.when(abstract != "", abstract).otherwise(venue), "extra": F.struct(i["publication_year"].alias("year"), venue.alias("venue"), names.alias("authors"), F.coalesce(i["cited_by_count"], F.lit(0)).alias("cited_by"))}

    return _hits(payloads, "openalex", _json(schema)["results"], make, limit)


def github(payloads: DataFrame, limit: int = 10) -> DataFrame:
    schema = "items array<struct<full_name: string, html_url: string, description: string, stargazers_count: int, language: string, updated_at: string>>"

    def make(i):
        stars, lang = F.coalesce(i["stargazers_count"], F.lit(0)), _text(i["language"])
        snip = F.concat(_text(i["description"]), F.lit(" ⭐"), stars.cast("string"), F.when(lang != "", F.concat(F.lit(" · "), lang)).otherwise(F.lit("")))
        return {"title": i["full_name"], "url": i["html_url"], "snippet": snip, "extra": F.struct(stars.alias("stars"), lang.alias("language"), F.substring(_text(i["updated_at"]), 1, 10).alias("updated"))}

    return _hits(payloads, "github", _json(schema)["items"], make, limit)


def stackexchange(payloads: DataFrame, limit: int = 10) -> DataFrame:
    schema = "items array<struct<title: string, body: string, link: string, tags: array<string>, score: int, is_answered: boolean>>"

    def make(i):
        tags = F.slice(F.coalesce(i["tags"], F.array().cast("array<string>")), 1, 6)
        return {"title": i["title"], "again": True, "url": i["link"], "snippet": i["body"], "cut": 400, "otherwise": F.array_join(tags, " "), "extra": F.struct(F.coalesce(i["score"], F.lit(0)).alias("score"), F.coalesce(i["is_answered"], F.lit(False)).alias("answered"), tags.alias("tags"))}

    return _hits(payloads, "stackexchange", _json(schema)["items"], make, limit)


def hackernews(payloads: DataFrame, limit: int = 10) -> DataFrame:
    schema = "hits array<struct<title: string, story_title: string, url: string, objectID: string, points: int, num_comments: int>>"

    def make(i):
        points, comments = F.coalesce(i["points"], F.lit(0)), F.coalesce(i["num_comments"], F.lit(0))
        url = F.when(_text(i["url"]) != "", i["url"]).otherwise(F.concat(F.lit("https://news.ycombinator.com/item?id="), _text(i["objectID"])))
        return {"title": F.when(_text(i["title"]) != "", i["title"]).otherwise(i["story_title"]), "url": url, "snippet": F.concat(points.cast("string"), F.lit(" points · "), comments.cast("string"), F.lit(" comments")), "extra": F.struct(points.alias("points"), comments.alias("comments"))}

    return _hits(payloads, "hackernews", _json(schema)["hits"], make, limit)


def arxiv(payloads: DataFrame, limit: int = 10) -> DataFrame:
    """An Atom feed."""
    schema = "entry array<struct<id: string, title: string, summary: string, published: string, author: array<struct<name: string>>, link: array<struct<_href: string, _rel: string, _title: string>>>>"

    def make(i):
        link = lambda attr, want: F.try_element_at(F.filter(F.coalesce(i["link"], F.array()), lambda x: x[attr] == want), F.lit(1))["_href"]
        names = F.transform(F.slice(F.coalesce(i["author"], F.array()), 1, 6), lambda a: _text(a["name"]))
        return {"title": i["title"], "url": F.coalesce(link("_rel", "alternate"), i["id"]), "snippet": i["summary"], "extra": F.struct(names.alias("authors"), F.substring(_text(i["published"]), 1, 10).alias("published"), _text(link("_title", "pdf")).alias("pdf"))}

    return _hits(payloads, "arxiv", F.from_xml("body", schema)["entry"], make, limit)


def result_page(payloads: DataFrame, engine_id: str, limit: int = 10) -> DataFrame:
    """Result pages in HTML, of any engine that has no service."""
    e = _ENGINE[engine_id]
    each = payloads.select("qid", "query", F.explode(html.result_hits(engine_id, limit)("body")).alias("h"))
    return each.select("qid", F.lit(engine_id).alias("engine_id"), F.lit(e[2]).alias("category"), F.lit(e[3]).alias("weight"), "query", "h.position", "h.title", "h.url", "h.snippet", F.lit("{}").alias("extra")).where((F.col("title") != "") & (F.col("url") != ""))


SERVICES = {
    "wikipedia_zh": lambda p, n: wikipedia(p, "zh", n), "wikipedia_en": lambda p, n: wikipedia(p, "en", n), "arxiv": arxiv, "crossref": crossref, "openalex": openalex, "github": github, "stackexchange": stackexchange, "hackernews": hackernews,
}


def parse(payloads: DataFrame, engine_id: str, limit: int = 10) -> DataFrame:
    """Hits of an engine's payloads; none for an unknown engine."""
    if engine_id in SERVICES:
        return SERVICES[engine_id](payloads, limit)
    return result_page(payloads if engine_id in _ENGINE else payloads.where("false"), engine_id if engine_id in _ENGINE else fixed.FALLBACK_ENGINE, limit)


def parse_all(payloads: DataFrame, limit: int = 10) -> DataFrame:
    """payloads(qid, engine_id, query, body) of all engines to hits."""
    out = None
    for e in fixed.ENGINES:
        own = parse(payloads.where(F.col("engine_id") == e[0]), e[0], limit)
        out = own if out is None else out.unionByName(own)
    return out


def addresses(tasks: DataFrame, limit: int = fixed.DEFAULTS["per_engine"]) -> DataFrame:
    """tasks(qid, engine_id, sent, ...) with url and headers: what to ask each engine for. Unknown engines get no row; a null text is an empty one."""
    sent = _text(F.col("sent"))
    # Plain words go to all fields of the one service whose queries name a field.
    prefixed = F.when(F.substring_index(F.trim(sent), " ", 1).contains(":"), F.trim(sent)).otherwise(F.concat(F.lit("all:"), F.trim(sent)))
    known = F.create_map(*[F.lit(x) for e, (a, most) in fixed.ENGINE_ADDRESSES.items() for x in (e, a.replace("{limit}", str(min(limit, most or limit))))])
    heads = F.create_map(*[y for e, h in fixed.ENGINE_HEADERS.items() for y in (F.lit(e), F.create_map(*[F.lit(x) for kv in h.items() for x in kv]))])
    form = urls.form_encoded(F.when(F.col("engine_id") == "arxiv", prefixed).otherwise(sent))
    url = F.replace(F.replace(F.try_element_at(known, F.col("engine_id")), F.lit("{form}"), form), F.lit("{path}"), urls.path_encoded(sent))
    none = F.create_map().cast("map<string,string>")
    return tasks.withColumns({"url": url, "headers": F.coalesce(F.try_element_at(heads, F.col("engine_id")), none)}).where("url IS NOT NULL")


def ask(tasks: DataFrame, store: Callable[[DataFrame, str], DataFrame], transport: Callable = fetch.default_transport, limit: int = fixed.DEFAULTS["per_engine"], min_interval: float = fixed.DEFAULTS["min_interval"]) -> DataFrame:
    """tasks(qid, engine_id, sent, timeout) to the hits of their engines. store keeps the answers, which all parsers read; a failed request has no hits."""
    wanted = addresses(tasks, limit)
    got = fetch.fetch(wanted.select("url", "timeout", F.lit(False).alias("check_robots"), "headers"), transport, min_interval).where("error = ''").select("url", "body")
    return parse_all(store(wanted.join(got, "url").select("qid", "engine_id", F.col("sent").alias("query"), "body"), "answers"), limit)
