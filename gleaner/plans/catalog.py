"""Registered queries of the evidence engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text, urls
from ..operators import evidence as ev
from . import inputs as i

FLAGSHIP = "score_sources"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def joined(c) -> F.Column:
    return F.md5(F.array_join(c, "\x1f"))


def sql_joined(x: str) -> str:
    return f"md5(array_to_string({x}, chr(31)))"


# ---- words and sentences ----------------------------------------------------------------------------------------------

_TOKEN_SQL = "SELECT {id}, len({t})::INT AS n_tokens, len(list_distinct({t}))::INT AS n_distinct, len({c})::INT AS n_content, {h} AS tokens FROM {source}"


def _tokens(df: DataFrame, key: str, column: str) -> DataFrame:
    t = text.tokenize(F.col(column))
    return df.select(key, F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), F.size(text.content_tokens(F.col(column))).alias("n_content"), joined(t).alias("tokens"))


def _token_sql(source: str, key: str, column: str) -> str:
    return _TOKEN_SQL.format(id=key, t="t", c="c", h=sql_joined("t"), source=f"(SELECT {key}, {i.sql_tokens(column)} AS t, {i.sql_content(column)} AS c FROM {source})")


@query(_token_sql("documents", "doc_id", "text"))
def tokenize_documents(spark, sf_dir):
    return _tokens(i.read(spark, sf_dir, "documents"), "doc_id", "text")


@query("WITH " + i.values("t0", "id, text", i.MIXED_TEXTS) + " " + _token_sql("t0", "id", "text"))
def tokenize_mixed(spark, sf_dir):
    return _tokens(i.table(spark, "id int, text string", i.MIXED_TEXTS), "id", "text")


@query(f"SELECT doc_id, len(s)::INT AS n_sentences, {sql_joined('s')} AS sentences FROM (SELECT doc_id, {i.sql_sentences('text')} AS s FROM documents)")
def split_sentences(spark, sf_dir):
    s = text.sentences(F.col("text"))
    return i.read(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n_sentences"), joined(s).alias("sentences"))


@query("WITH " + i.values("t0", "id, text", i.MIXED_TEXTS) + f" SELECT id, len(s)::INT AS n_sentences, {sql_joined('s')} AS sentences FROM (SELECT id, {i.sql_sentences('text')} AS s FROM t0)")
def split_sentences_mixed(spark, sf_dir):
    s = text.sentences(F.col("text"))
    return i.table(spark, "id int, text string", i.MIXED_TEXTS).select("id", F.size(s).alias("n_sentences"), joined(s).alias("sentences"))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({i.sql_tokens('text')})) AS term FROM documents) GROUP BY term")
def doc_frequency(spark, sf_dir):
    return i.read(spark, sf_dir, "documents").select(F.explode(text.token_set(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({i.sql_content('text')}) AS term FROM documents) GROUP BY term")
def term_frequencies(spark, sf_dir):
    return i.read(spark, sf_dir, "documents").select(F.explode(text.content_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH t AS (SELECT doc_id, unnest(c) AS term, unnest(range(len(c))) AS p FROM (SELECT doc_id, {i.sql_content('text')} AS c FROM documents)),
n AS (SELECT doc_id, term, count(*) AS n, min(p) AS first FROM t GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first)::INT AS pos, term, n FROM n QUALIFY pos <= 10
""")
def top_terms_of_text(spark, sf_dir):
    each = i.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.content_tokens(F.col("text"))).alias("p", "term"))
    counts = each.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first"))
    return ev.top_k(counts, [F.desc("n"), "first"], 10, "doc_id", "pos").select("doc_id", "pos", "term", "n")


@query("WITH " + i.values("t0", "id, text", i.MIXED_TEXTS) + r""", x AS (SELECT id, regexp_replace(text, '[　-〿一-鿿＀-￯]+', ' ', 'g') AS a, regexp_replace(text, '<[^>]+>', '', 'g') AS b FROM t0)
SELECT id, regexp_replace(regexp_replace(a, '\s+', ' ', 'g'), '^ | $', '', 'g') AS latin, regexp_replace(lower(text), '[^一-鿿 a-zA-Z0-9]', '', 'g') AS title_key, regexp_matches(text, '[一-鿿]') AS chinese FROM x JOIN t0 USING (id)""")
def strip_cjk_and_keys(spark, sf_dir):
    c = F.col("text")
    return i.table(spark, "id int, text string", i.MIXED_TEXTS).select("id", text.strip_cjk(c).alias("latin"), text.title_key(c).alias("title_key"), c.rlike(fixed.CJK).alias("chinese"))


_MARKUP = [(1, "<em>固态</em> 电池 <b>x</b>  y"), (2, "中 文 字 and 中 <i>文</i>"), (3, None), (4, "no tags")]


@query("WITH " + i.values("t0", "id, html", [(k, h) for k, h in _MARKUP]) + rf""", s AS (SELECT id, {i.sql_squeeze("regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g')")} AS s FROM t0)
SELECT id, regexp_replace(regexp_replace(s, '([一-鿿]) +([一-鿿])', '\1\2', 'g'), '([一-鿿]) +([一-鿿])', '\1\2', 'g') AS cleaned FROM s""")
def clean_markup(spark, sf_dir):
    return i.table(spark, "id int, html string", _MARKUP).select("id", text.clean_markup(F.col("html")).alias("cleaned"))


@query(rf"SELECT doc_id, len(p)::INT AS n_paragraphs, {sql_joined('p')} AS paragraphs FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, '. ', '.' || chr(10) || chr(10)), '\n\s*\n'), lambda s: {i.sql_squeeze('s')}), lambda s: length(s) >= 25 AND regexp_matches(s, '[\pL\pN_]')) AS p FROM documents)")
def split_paragraphs(spark, sf_dir):
    p = text.paragraphs(F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n")))
    return i.read(spark, sf_dir, "documents").select("doc_id", F.size(p).alias("n_paragraphs"), joined(p).alias("paragraphs"))


@query(r"""SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE round(least(length(text), 1500) / 100.0::DOUBLE + least(len(regexp_extract_all(text, '[。！？；…]|[.!?;](?:\s|$)')), 60) * 0.9::DOUBLE
  + CASE WHEN regexp_matches(text, '[一-鿿]') THEN least(length(text) / 120.0::DOUBLE, 12) ELSE least(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) / 25.0::DOUBLE, 12) END, 6) END AS score FROM documents""")
def text_score(spark, sf_dir):
    return i.read(spark, sf_dir, "documents").select("doc_id", F.round(text.text_score(F.col("text")), 6).alias("score"))


# ---- addresses --------------------------------------------------------------------------------------------------------

_URLS = "id int, url string"


@query(f"SELECT page_id, {i.sql_normalize('url')} AS normal, substr(sha1({i.sql_normalize('url')}), 1, 16) AS url_key, {i.sql_domain('url')} AS domain FROM pages")
def normalize_url_pages(spark, sf_dir):
    u = F.col("url")
    return i.read(spark, sf_dir, "pages").select("page_id", urls.normalize(u).alias("normal"), urls.key(u).alias("url_key"), urls.domain(u).alias("domain"))


@query("WITH " + i.values("t0", "id, url", i.URL_ROWS[:2] + i.URL_ROWS[3:11]) + f" SELECT id, {i.sql_normalize('url')} AS normal, {i.sql_domain('url')} AS domain FROM t0")
def normalize_url_cases(spark, sf_dir):
    u = F.col("url")
    return i.table(spark, _URLS, i.URL_ROWS[:2] + i.URL_ROWS[3:11]).select("id", urls.normalize(u).alias("normal"), urls.domain(u).alias("domain"))


@query(f"SELECT {i.sql_normalize('url')} AS normal, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1")
def url_key_groups(spark, sf_dir):
    return i.read(spark, sf_dir, "pages").groupBy(urls.normalize(F.col("url")).alias("normal")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))


_BAD = i.lit(list(fixed.NO_CONTENT))


@query(f"SELECT page_id, regexp_matches(lower(url), '^https?://') AND NOT list_bool_or(list_transform({_BAD}, lambda b: contains(lower(url), b))) AS content FROM pages".replace("list_bool_or(list_transform(", "(len(list_filter(").replace("lambda b: contains(lower(url), b))) AS", "lambda b: contains(lower(url), b))) > 0) AS"))
def content_url_pages(spark, sf_dir):
    return i.read(spark, sf_dir, "pages").select("page_id", urls.holds_content(F.col("url")).alias("content"))


@query("WITH " + i.values("t0", "id, url", i.URL_ROWS) + f" SELECT id, regexp_matches(lower(url), '^https?://') AND len(list_filter({_BAD}, lambda b: contains(lower(url), b))) = 0 AS content FROM t0")
def content_url_cases(spark, sf_dir):
    return i.table(spark, _URLS, i.URL_ROWS).select("id", urls.holds_content(F.col("url")).alias("content"))


@query("WITH " + i.values("t0", "id, url", i.URL_ROWS) + r""", c AS (SELECT id, url, replace(replace(regexp_extract(url, '[?&]u=a1([^&]+)', 1), '-', '+'), '_', '/') AS b FROM t0)
SELECT id, CASE WHEN contains(url, 'bing.com/ck/a') AND b <> '' THEN decode(from_base64(b || repeat('=', ((4 - length(b) % 4) % 4)::INT))) ELSE url END AS target FROM c""")
def unwrap_redirect(spark, sf_dir):
    return i.table(spark, _URLS, i.URL_ROWS).select("id", urls.unwrap(F.col("url")).alias("target"))


@query(f"SELECT page_id, domain, round({i.sql_authority('domain')}, 9) AS authority FROM (SELECT page_id, {i.sql_domain('url')} AS domain FROM pages)")
def authority_of_pages(spark, sf_dir):
    pages = i.read(spark, sf_dir, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))
    return ev.authority(pages).withColumn("authority", F.round("authority", 9))


@query("WITH " + i.values("t0", "id, url", i.URL_ROWS) + f" SELECT id, round({i.sql_authority('d')}, 9) AS authority FROM (SELECT id, {i.sql_domain('url')} AS d FROM t0)")
def authority_cases(spark, sf_dir):
    return ev.authority(i.table(spark, _URLS, i.URL_ROWS).select("id", urls.domain(F.col("url")).alias("domain"))).select("id", F.round("authority", 9).alias("authority"))


_SITES = [(1, "example.org", "example.org"), (2, "a.example.org", "example.org"), (3, "example.org", "b.c.example.org"), (4, "badexample.org", "example.org"), (5, "", "example.org"), (6, "a.org", "b.org")]


@query("WITH " + i.values("t0", "id, a, b", _SITES) + " SELECT id, a <> '' AND b <> '' AND (a = b OR ends_with(a, '.' || b) OR ends_with(b, '.' || a)) AS same FROM t0")
def same_site_cases(spark, sf_dir):
    return i.table(spark, "id int, a string, b string", _SITES).select("id", urls.same_site(F.col("a"), F.col("b")).alias("same"))


@query(f"WITH d AS (SELECT DISTINCT {i.sql_domain('url')} AS d FROM pages) SELECT x.d AS a, y.d AS b FROM d x JOIN d y ON x.d <> y.d AND x.d <> '' AND y.d <> '' AND ends_with(x.d, '.' || y.d)")
def same_site_pages(spark, sf_dir):
    """Domains of pages that belong to others; a join on all endings of a domain, no pairs that do not match."""
    d = i.read(spark, sf_dir, "pages").select(urls.domain(F.col("url")).alias("a")).distinct().where("a <> ''")
    parts = F.split("a", r"\.")
    ends = d.select("a", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("b"))
    return ends.join(d.select(F.col("a").alias("b")), "b").select("a", "b")


# ---- dates and times --------------------------------------------------------------------------------------------------

_DATES = [(1, "2026-05-20T08:00"), (2, "published 2019/3/7"), (3, "2024年1月2日"), (4, "in 1985"), (5, ""), (6, "2031-01-01"), (7, "1999"), (8, "no date"), (9, "from 1875 to 2020")]


@query("WITH " + i.values("t0", "id, published", _DATES) + rf""", y AS (SELECT *, TRY_CAST(regexp_extract(published, '(19|20)\d{{2}}') AS INT) AS y, regexp_extract(published, '((?:19|20)\d{{2}})[-/年](\d{{1,2}})[-/月](\d{{1,2}})', ['a', 'b', 'c']) AS p FROM t0)
SELECT id, CASE WHEN y BETWEEN 1990 AND {i.NOW_YEAR + 1} THEN y::VARCHAR ELSE '' END AS year, round(CASE WHEN y BETWEEN 1990 AND {i.NOW_YEAR + 1} THEN greatest(0.15, 1.0 - greatest(0, {i.NOW_YEAR} - y) * 0.14) ELSE 0.5 END, 9)::DOUBLE AS freshness,
  CASE WHEN p.a <> '' THEN p.a || '-' || lpad(p.b, 2, '0') || '-' || lpad(p.c, 2, '0') ELSE regexp_extract(published, '((?:19|20)\d{{2}})', 1) END AS day FROM y""")
def freshness_cases(spark, sf_dir):
    p = F.col("published")
    return i.table(spark, "id int, published string", _DATES).select("id", F.coalesce(text.year_of(p, i.NOW_YEAR).cast("string"), F.lit("")).alias("year"), F.round(text.freshness(p, i.NOW_YEAR), 9).alias("freshness"), text.publication_date(p).alias("day"))


@query(rf"""WITH y AS (SELECT doc_id, list_max(list_filter(list_transform(regexp_extract_all(text, '((?:19|20)\d{{2}})'), lambda v: v::INT), lambda v: v BETWEEN 1990 AND {i.NOW_YEAR + 1})) AS y FROM documents)
SELECT doc_id, round(CASE WHEN y IS NULL THEN 0.5 ELSE greatest(0.15, 1.0 - greatest(0, {i.NOW_YEAR} - y) * 0.14) END, 9)::DOUBLE AS freshness FROM y""")
def freshness_documents(spark, sf_dir):
    return i.read(spark, sf_dir, "documents").select("doc_id", F.round(text.freshness(F.lit(""), i.NOW_YEAR, F.col("text"), chars=None), 9).alias("freshness"))


_SECONDS = [(1, 0.0), (2, 12.34), (3, 59.94), (4, 60.0), (5, 125.9), (6, 3725.0)]


@query("WITH " + i.values("t0", "id, s", _SECONDS) + " SELECT id, CASE WHEN s < 60 THEN printf('%.1fs', s::DOUBLE) ELSE floor(s / 60)::BIGINT || 'm' || floor(s % 60)::BIGINT || 's' END AS t FROM t0")
def short_times(spark, sf_dir):
    return i.table(spark, "id int, s double", _SECONDS).select("id", text.short_time(F.col("s")).alias("t"))


_HEADS = [(1, '<meta charset="GBK">'), (2, "<html><META content='text/html; charset=Shift_JIS'>"), (3, "<p>none</p>"), (4, "")]


@query("WITH " + i.values("t0", "id, head", _HEADS) + r""" SELECT id, lower(regexp_extract(head, '(?i)<meta[^>]+charset\s*=\s*["'']?\s*([a-z0-9_\-]+)', 1)) AS charset FROM t0""")
def sniff_charset(spark, sf_dir):
    return i.table(spark, "id int, head string", _HEADS).select("id", text.sniff_charset(F.encode("head", "ISO-8859-1")).alias("charset"))


# ---- relevance --------------------------------------------------------------------------------------------------------


@query(f"WITH {i.CORPUS}, {i.QUESTIONS}, {i.TERMS}, {i.BM25} SELECT qid, sid, round(bm25, 6) AS bm25 FROM bm")
def bm25_benchmark(spark, sf_dir):
    corpus, q = i.corpus(spark, sf_dir), i.questions(spark, sf_dir)
    return ev.bm25(corpus, None, q).withColumn("bm25", F.round("bm25", 6))


_PARTS = ("relevance", "authority", "freshness", "depth", "corroboration", "score")


@query(f"WITH {i.CORPUS}, {i.QUESTIONS}, {i.TERMS}, {i.BM25}, {i.SCORED} SELECT qid, idx::INT AS idx, sid, {', '.join(f'round({p}, 6)::DOUBLE AS {p}' for p in _PARTS)} FROM ranked WHERE idx <= 14")
def score_sources(spark, sf_dir):
    """The flagship: the best sources of each question."""
    corpus, q = i.corpus(spark, sf_dir), i.questions(spark, sf_dir)
    best = ev.score_sources(corpus, None, q, i.NOW_YEAR).where(F.col("idx") <= fixed.DEFAULTS["max_sources"])
    return best.select("qid", "idx", "sid", *[F.round(p, 6).alias(p) for p in _PARTS])


@query(f"WITH {i.CORPUS}, {i.QUESTIONS}, {i.TERMS}, {i.BM25} SELECT qid, sid, round(CASE WHEN max(bm25) OVER w - min(bm25) OVER w < 1e-9 THEN 0.5 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END, 6) AS scaled FROM bm WINDOW w AS (PARTITION BY qid)")
def minmax_normalize(spark, sf_dir):
    corpus, q = i.corpus(spark, sf_dir), i.questions(spark, sf_dir)
    return ev.scaled(ev.bm25(corpus, None, q), "bm25", "s").select("qid", "sid", F.round("s", 6).alias("scaled"))


@query(f"""WITH {i.CORPUS}, {i.QUESTIONS}, q AS (SELECT qid, list_distinct({i.sql_content('query')}) AS t FROM questions), c AS (SELECT sid, list_distinct({i.sql_tokens('title')}) AS t FROM corpus),
p AS (SELECT DISTINCT qid, sid FROM (SELECT qid, unnest(t) AS term FROM q) JOIN (SELECT sid, unnest(t) AS term FROM c) USING (term))
SELECT qid, sid, round(len(list_intersect(q.t, c.t)) / len(list_distinct(list_concat(q.t, c.t)))::DOUBLE, 9) AS jaccard, round(len(list_intersect(q.t, c.t)) / len(q.t)::DOUBLE, 9) AS containment FROM p JOIN q USING (qid) JOIN c USING (sid)""")
def jaccard_titles(spark, sf_dir):
    q = i.questions(spark, sf_dir).select("qid", F.array_distinct(text.content_tokens(F.col("query"))).alias("t"))
    c = i.corpus(spark, sf_dir).select("sid", text.token_set(F.col("title")).alias("u"))
    pairs = q.select("qid", F.explode("t").alias("term")).join(c.select("sid", F.explode("u").alias("term")), "term").select("qid", "sid").distinct()
    return pairs.join(q, "qid").join(c, "sid").select("qid", "sid", F.round(text.jaccard(F.col("t"), F.col("u")), 9).alias("jaccard"), F.round(text.containment(F.col("t"), F.col("u")), 9).alias("containment"))


@query(f"WITH {i.CORPUS}, {i.QUESTIONS}, {i.TERMS}, {i.BM25}, k AS (SELECT qid, sid, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, sid)::INT AS idx FROM bm) SELECT * FROM k WHERE idx <= 5")
def topk_per_question(spark, sf_dir):
    corpus, q = i.corpus(spark, sf_dir), i.questions(spark, sf_dir)
    return ev.top_k(ev.bm25(corpus, None, q), [F.desc(F.round("bm25", 9)), "sid"], 5).select("qid", "sid", "idx")


# ---- hits -------------------------------------------------------------------------------------------------------------

_GROUPED = f"""keyed AS (SELECT *, {i.sql_normalize('url')} AS key FROM hits), g AS (
  SELECT qid, key, list_sort(list(DISTINCT engine_id)) AS engines, count(DISTINCT query) AS n_queries, min(position) AS position, min(ord) AS first, arg_max({{'url': url, 'title': title, 'snippet': snippet}}, length(snippet) * 1000000000 - ord) AS b FROM keyed GROUP BY qid, key
)"""
_WEIGHTS = "MAP {" + ", ".join(f"{i.lit(e[0])}: {e[3]!r}" for e in fixed.ENGINES) + "}"


@query(f"""WITH {i.HITS}, {i.QUESTIONS}, {_GROUPED}, q AS (SELECT qid, list_distinct({i.sql_content('query')}) AS t FROM questions),
a AS (SELECT *, {i.sql_authority('d')} AS authority FROM (SELECT *, {i.sql_domain('b.url')} AS d FROM g JOIN q USING (qid))),
s AS (SELECT qid, key, array_to_string(engines, ',') AS engines, first, 3.0 * coalesce(list_max(list_transform(engines, lambda e: {_WEIGHTS}[e])), 0.5) + 2.2 * (len(engines) - 1) + greatest(0, 2.5 - position * 0.18) + 2.0 * authority + 0.8 * (n_queries - 1)
  + CASE WHEN len(t) = 0 THEN 0 ELSE (3.0 * len(list_intersect(list_distinct({i.sql_tokens('b.title')}), t)) + len(list_intersect(list_distinct({i.sql_tokens('b.snippet')}), t))) / len(t)::DOUBLE END AS score FROM a)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, first)::INT AS rank, key, engines, round(score, 6)::DOUBLE AS score FROM s""")
def rank_hits(spark, sf_dir):
    ranked = ev.rank_hits(i.hits(spark, sf_dir), i.questions(spark, sf_dir), ev.engines_table(spark))
    return ranked.select("qid", "rank", "key", F.array_join("engines", ",").alias("engines"), F.round("score", 6).alias("score"))


@query(f"WITH {i.HITS}, {_GROUPED} SELECT qid, key, array_to_string(engines, ',') AS engines, n_queries, position::INT AS position, b.url AS url FROM g")
def group_hits(spark, sf_dir):
    return ev.group_hits(i.hits(spark, sf_dir)).select("qid", "key", F.array_join("engines", ",").alias("engines"), "n_queries", "position", "url")


@query(f"WITH {i.HITS}, {_GROUPED} SELECT qid, key FROM g WHERE NOT EXISTS (SELECT 1 FROM keyed k WHERE k.qid = g.qid AND k.key = g.key AND k.query = 'q0')")
def anti_seen_urls(spark, sf_dir):
    """Addresses that round 0 has not shown."""
    hits = i.hits(spark, sf_dir).withColumn("key", urls.normalize(F.col("url")))
    return ev.group_hits(hits).select("qid", "key").join(hits.where("query = 'q0'").select("qid", "key").distinct(), ["qid", "key"], "left_anti")


@query(f"WITH {i.HITS} SELECT query AS round, count(*) AS hits, count(DISTINCT engine_id) AS engines, count(DISTINCT qid) AS questions FROM hits GROUP BY query")
def round_union(spark, sf_dir):
    """Hits of the rounds, one below the other, counted."""
    hits = i.hits(spark, sf_dir)
    rounds = [hits.where(F.col("query") == f"q{r}").withColumn("round", F.lit(f"q{r}")) for r in range(3)]
    every = rounds[0].unionByName(rounds[1]).unionByName(rounds[2])
    return every.groupBy("round").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("engine_id").alias("engines"), F.countDistinct("qid").alias("questions"))


@query(f"WITH {i.HITS}, c AS (SELECT qid, engine_id, sum(CASE WHEN position <= 8 THEN 1 ELSE 0 END)::BIGINT AS hits, CASE WHEN engine_id = 'nobody' THEN 'timeout' END AS error FROM hits GROUP BY ALL) SELECT engine_id, sum(hits)::BIGINT AS hits, count(*) AS calls, count(error) AS errors FROM c GROUP BY engine_id")
def engine_stats(spark, sf_dir):
    calls = i.hits(spark, sf_dir).groupBy("qid", "engine_id").agg(F.count_if(F.col("position") <= fixed.DEFAULTS["per_engine"]).alias("hits"), F.lit(0).alias("ms")).withColumn("error", F.when(F.col("engine_id") == "nobody", "timeout"))
    return ev.engine_stats(calls).select("engine_id", "hits", "calls", "errors")


_OVER = [("bing_cn", "0.5"), ("arxiv", "high"), ("nobody", "1"), ("github", "1.25")]


@query("WITH " + i.values("e", "id, weight", [(e[0], e[3]) for e in fixed.ENGINES]) + ", " + i.values("o", "id, w", _OVER) + " SELECT e.id, coalesce(TRY_CAST(w AS DOUBLE), weight)::DOUBLE AS weight FROM e LEFT JOIN o ON e.id = o.id")
def engine_weights_override(spark, sf_dir):
    return ev.engine_weights(ev.engines_table(spark), i.table(spark, "id string, w string", _OVER)).select("id", "weight")


@query("WITH " + i.values("e", "ord, id, name, category, tier, timeout, english_only", [(k + 1, e[0], e[1], e[2], e[4], e[5], e[6]) for k, e in enumerate(fixed.ENGINES)]) + " SELECT row_number() OVER (ORDER BY id)::INT AS pos, id, name, category, tier, timeout::DOUBLE AS timeout, english_only FROM e")
def engine_names(spark, sf_dir):
    from pyspark.sql import Window as W

    return ev.engines_table(spark).select(F.row_number().over(W.orderBy("id")).alias("pos"), "id", "name", "category", "tier", "timeout", "english_only")  # sixteen rows


_CACHE = [("a", 1000.0, "x"), ("a", 1500.0, "y"), ("b", 100.0, "z"), ("c", 1100.0, "w"), ("c", 1099.5, "v")]


@query("WITH " + i.values("c", "url_sha1, ts, body", _CACHE) + " SELECT url_sha1, max(ts)::DOUBLE AS ts, arg_max(body, ts) AS body FROM c WHERE ts >= 2000 - 900 GROUP BY url_sha1")
def cache_ttl_filter(spark, sf_dir):
    return ev.fresh_cache(i.table(spark, "url_sha1 string, ts double, body string", _CACHE), 2000.0, 900)


# ---- intents, routing, subjects ---------------------------------------------------------------------------------------

_QUESTIONS = i.values("t0", "qid, query, hint", i.QUESTION_ROWS)
_INTENT = "CASE WHEN list_contains(" + i.lit(list(fixed.INTENT_ENGINES)) + ", hint) THEN hint WHEN regexp_matches(query, '(?i)" + fixed.ADVANCED.replace("'", "''") + "') THEN 'advanced' " + " ".join(f"WHEN len(list_filter({i.lit(w)}, lambda k: contains(lower(query), k))) > 0 THEN {i.lit(n)}" for n, w in fixed.INTENT_WORDS) + " ELSE 'general' END"


def _question_rows(spark) -> DataFrame:
    return i.table(spark, "qid int, query string, hint string", i.QUESTION_ROWS)


@query(f"WITH {_QUESTIONS} SELECT qid, {_INTENT} AS intent FROM t0")
def detect_intent(spark, sf_dir):
    return _question_rows(spark).select("qid", ev.intent(F.col("query"), F.col("hint")).alias("intent"))


@query(f"WITH {i.QUESTIONS} SELECT qid, {_INTENT.replace('hint', 'NULL')} AS intent FROM questions".replace("list_contains(" + i.lit(list(fixed.INTENT_ENGINES)) + ", NULL)", "FALSE"))
def detect_intent_benchmark(spark, sf_dir):
    return i.questions(spark, sf_dir).select("qid", ev.intent(F.col("query")).alias("intent"))


_IN, _OUT = ["sogou", "nobody", "bing_cn"], ["baidu", "arxiv", "brave"]


@query(f"""WITH {_QUESTIONS}, r AS (SELECT qid, {_INTENT} AS intent FROM t0), m AS (SELECT qid, intent, list_filter(list_concat(base, list_filter(['sogou', 'bing_cn'], lambda e: NOT list_contains(base, e))), lambda e: NOT list_contains({i.lit(_OUT)}, e)) AS ids
FROM (SELECT *, MAP {{{', '.join(f'{i.lit(k)}: {i.lit(v)}' for k, v in fixed.INTENT_ENGINES.items())}}}[intent] AS base FROM r))
SELECT qid, intent, unnest(ids) AS engine_id, unnest(range(1, len(ids) + 1))::INT AS pos FROM m""")
def engine_routing(spark, sf_dir):
    q = _question_rows(spark).withColumns({"include": F.array(*map(F.lit, _IN)), "exclude": F.array(*map(F.lit, _OUT))})
    return ev.route(q).select("qid", "intent", "engine_id", "pos")


_LATIN_ONLY = r"regexp_replace(regexp_replace(regexp_replace(query, '[　-〿一-鿿＀-￯]+', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"""WITH {_QUESTIONS}, {i.values('e', 'id, english_only', [(e[0], e[6]) for e in fixed.ENGINES])}, r AS (SELECT qid, query, {_INTENT} AS intent FROM t0),
x AS (SELECT qid, query, unnest(MAP {{{', '.join(f'{i.lit(k)}: {i.lit(v)}' for k, v in fixed.INTENT_ENGINES.items())}}}[intent]) AS engine_id FROM r)
SELECT qid, engine_id, CASE WHEN english_only THEN {_LATIN_ONLY} ELSE query END AS sent FROM x JOIN e ON e.id = x.engine_id WHERE NOT english_only OR length({_LATIN_ONLY}) >= 2""")
def search_tasks(spark, sf_dir):
    """Sub-queries with the engines they go to; CJK queries are kept from engines that read English only."""
    q = _question_rows(spark)
    routes = ev.route(q.withColumns({"include": F.array().cast("array<string>"), "exclude": F.array().cast("array<string>")}))
    return ev.search_tasks(q.select("qid", F.col("query").alias("text")), routes, ev.engines_table(spark)).select("qid", "engine_id", "sent")


def _subject_sql(q: str) -> str:
    s = f"trim({q})"
    for pattern in (fixed.ASK_PREFIX, fixed.ASK_SUFFIX, fixed.FACET_TAIL, fixed.MARKS_TAIL, fixed.ASK_PREFIX):
        flag = "(?i)" if pattern == fixed.ASK_PREFIX else ""
        s = f"regexp_replace({s}, '{flag}{pattern}', '')"
    return f"CASE WHEN trim({s}) = '' THEN trim({q}) ELSE trim({s}) END"


@query(f"WITH {_QUESTIONS} SELECT qid, {_subject_sql('query')} AS subject FROM t0")
def extract_subject(spark, sf_dir):
    from ..operators.planning import subject

    return _question_rows(spark).select("qid", subject(F.col("query")).alias("subject"))


# ---- coverage ---------------------------------------------------------------------------------------------------------

_COVER = "CASE f.facet " + " ".join(f"WHEN {i.lit(f[0])} THEN " + " + ".join(f"max(contains(lower(text), {i.lit(w.lower())})::INT)" for w in f[4]) for f in fixed.FACETS) + " END"
_COVER_SQL = "WITH {source}, " + i.values("f", "facet", [(f[0],) for f in fixed.FACETS]) + f", c AS (SELECT qid, f.facet, ({_COVER})::BIGINT AS hits FROM texts, f GROUP BY qid, f.facet)"
_BY_SOURCE = "texts AS (SELECT source AS qid, text FROM documents)"
_COVERED = [(1, "The definition refers to a mechanism. 定义"), (1, "However, the failure rate is 5 percent"), (2, "最新进展 2025 与 对比"), (2, "PROS AND CONS of the pipeline"), (3, "nothing")]


@query(_COVER_SQL.format(source=_BY_SOURCE) + " SELECT qid, facet, hits FROM c")
def facet_coverage(spark, sf_dir):
    return ev.facet_coverage(i.read(spark, sf_dir, "documents").select(F.col("source").alias("qid"), "text")).select("qid", "facet", "hits")


@query(_COVER_SQL.format(source=i.values("texts", "qid, text", _COVERED)) + " SELECT qid, facet FROM c WHERE hits < 1")
def facet_gaps(spark, sf_dir):
    return ev.uncovered(ev.facet_coverage(i.table(spark, "qid int, text string", _COVERED))).select("qid", "facet")


@query(_COVER_SQL.format(source=_BY_SOURCE) + " SELECT qid, facet FROM c WHERE hits < 1")
def facet_gaps_documents(spark, sf_dir):
    return ev.uncovered(ev.facet_coverage(i.read(spark, sf_dir, "documents").select(F.col("source").alias("qid"), "text"))).select("qid", "facet")


@query(_COVER_SQL.format(source=i.values("texts", "qid, text", _COVERED)) + ", o AS (SELECT facet, ord FROM (VALUES " + ", ".join(f"({i.lit(f[0])}, {k})" for k, f in enumerate(fixed.FACETS)) + ") AS v(facet, ord)), p AS (SELECT * FROM (VALUES " + ", ".join(f"({i.lit(f)}, {k})" for k, f in enumerate(fixed.INTENT_FACETS['academic'])) + ") AS v(facet, prio)) SELECT qid, facet, row_number() OVER (PARTITION BY qid ORDER BY coalesce(prio, 99), ord)::INT AS pos FROM c JOIN o USING (facet) LEFT JOIN p USING (facet) WHERE hits < 1")
def empty_facets_by_intent(spark, sf_dir):
    cover = ev.facet_coverage(i.table(spark, "qid int, text string", _COVERED))
    return ev.empty_facets(cover, cover.select("qid").distinct().withColumn("intent", F.lit("academic")))


@query(f"""WITH {i.CORPUS}, o AS (SELECT sid % 7 AS qid, sid, {i.sql_domain('url')} AS domain, length(content) AS chars, length(content) >= 200 AS ok FROM corpus),
t AS (SELECT qid, domain, count(*) AS n, min(sid) AS first FROM o WHERE ok GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, first) AS idx FROM t QUALIFY idx <= 8),
d AS (SELECT qid, string_agg(domain || '=' || n, ',' ORDER BY idx) AS top_domains FROM k GROUP BY qid)
SELECT o.qid, count(*) AS sources_total, count(*) FILTER (ok) AS sources_with_content, count(DISTINCT CASE WHEN ok THEN domain END) AS distinct_domains, coalesce(floor(avg(chars) FILTER (ok)), 0)::BIGINT AS avg_chars, coalesce(sum(chars) FILTER (ok), 0)::BIGINT AS total_chars, '' AS year_min, '' AS year_max, any_value(coalesce(top_domains, '')) AS top_domains
FROM o LEFT JOIN d ON o.qid = d.qid GROUP BY o.qid""")
def coverage_report(spark, sf_dir):
    """The documents as seven questions' sources."""
    year = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return ev.coverage_report(i.corpus(spark, sf_dir).withColumn("qid", F.col("sid") % 7), i.NOW_YEAR).withColumns({"year_min": year("year_min"), "year_max": year("year_max")})


_STATUS = [(1, True, "x" * 300), (2, True, "short"), (3, False, "y" * 300), (4, None, None), (5, True, None), (6, True, "z" * 200)]


@query("WITH " + i.values("t0", "id, fetched, content", _STATUS) + " SELECT id, CASE WHEN NOT coalesce(fetched, FALSE) THEN 'fetch_failed' WHEN length(coalesce(content, '')) < 200 THEN 'empty' ELSE 'ok' END AS status FROM t0")
def source_status(spark, sf_dir):
    return ev.source_status(i.table(spark, "id int, fetched boolean, content string", _STATUS)).select("id", "status")


# ---- fingerprints -----------------------------------------------------------------------------------------------------

_PRINTS = f"""tok AS (SELECT doc_id, unnest({i.sql_content('text')}) AS t FROM documents), w AS (SELECT doc_id, t, count(*) AS w, ('0x' || substr(md5(t), 1, 8))::BIGINT AS hi, ('0x' || substr(md5(t), 9, 8))::BIGINT AS lo FROM tok GROUP BY doc_id, t),
v AS (SELECT doc_id, b, sum(CASE WHEN ((CASE WHEN b < 32 THEN lo ELSE hi END) >> (b % 32)) & 1 = 1 THEN w ELSE -w END) > 0 AS one FROM w, (SELECT unnest(range(64)) AS b) GROUP BY doc_id, b),
p AS (SELECT doc_id, (sum(CASE WHEN one AND b < 63 THEN (1::HUGEINT << b) WHEN one THEN -(1::HUGEINT << 63) ELSE 0 END))::BIGINT AS fingerprint FROM v GROUP BY doc_id)"""


@query(f"WITH {_PRINTS} SELECT d.doc_id, coalesce(fingerprint, 0)::BIGINT AS fingerprint FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN p ON d.doc_id = p.doc_id")
def simhash_documents(spark, sf_dir):
    return ev.simhash(i.read(spark, sf_dir, "documents"), "doc_id", text.content_tokens(F.col("text")))


@query(f"WITH {_PRINTS}, c AS (SELECT fingerprint AS f, min(doc_id) AS first, count(*) AS n FROM p WHERE fingerprint <> 0 GROUP BY 1) SELECT least(a.first, b.first) AS a, greatest(a.first, b.first) AS b, bit_count(xor(a.f, b.f))::INT AS distance FROM c a JOIN c b ON a.f < b.f WHERE bit_count(xor(a.f, b.f)) <= 6")
def near_dup_pairs(spark, sf_dir):
    """Pairs of different fingerprints within distance 6, each shown by its first document; equal ones are one class."""
    prints = ev.token_prints(i.read(spark, sf_dir, "documents"), "doc_id", text.content_tokens(F.col("text")))
    pairs = ev.near_pairs(prints.where("fingerprint <> 0").groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    return pairs.select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"), "distance")


# ---- terms, sentences, divergences ------------------------------------------------------------------------------------


@query("WITH " + i.values("t0", "id, text", i.MIXED_TEXTS) + """, r AS (SELECT unnest(regexp_extract_all(text, '[一-鿿]+')) AS r FROM t0), g AS (SELECT substr(r, s, n) AS term, CASE WHEN s > 1 THEN substr(r, s - 1, 1) END AS l, CASE WHEN s + n <= length(r) THEN substr(r, s + n, 1) END AS e FROM r, (SELECT unnest(range(2, 7)) AS n), LATERAL (SELECT unnest(range(1, length(r) - n + 2)) AS s)),
f AS (SELECT term, count(*) AS freq FROM g GROUP BY term HAVING count(*) >= 2), hl AS (SELECT term, -sum(k / t * ln(k / t)) AS h FROM (SELECT term, l, count(*)::DOUBLE AS k, sum(count(*)) OVER (PARTITION BY term) AS t FROM g WHERE l IS NOT NULL GROUP BY term, l) GROUP BY term),
hr AS (SELECT term, -sum(k / t * ln(k / t)) AS h FROM (SELECT term, e, count(*)::DOUBLE AS k, sum(count(*)) OVER (PARTITION BY term) AS t FROM g WHERE e IS NOT NULL GROUP BY term, e) GROUP BY term),
x AS (SELECT f.term, freq, least(coalesce(hl.h, 0), coalesce(hr.h, 0)) AS boundary FROM f LEFT JOIN hl USING (term) LEFT JOIN hr USING (term))
SELECT term, freq, round(boundary, 6) AS boundary, round(freq * (1.0 + least(length(term), 6) / 6.0::DOUBLE) * (1.0 + boundary), 6) AS score FROM x WHERE boundary >= CASE WHEN length(term) >= 3 THEN 0.8 ELSE 0.6 END""")
def discover_terms(spark, sf_dir):
    found = ev.discover_terms(i.table(spark, "id int, text string", i.MIXED_TEXTS).withColumn("qid", F.lit(1)))
    return found.select("term", "freq", F.round("boundary", 6).alias("boundary"), F.round("score", 6).alias("score"))


_BEST = f"WITH {i.CORPUS}, {i.QUESTIONS}, {i.TERMS}, {i.BM25}, {i.SCORED}, best AS (SELECT qid, idx, sid, score, content FROM ranked JOIN corpus USING (sid) WHERE idx <= 14), q AS (SELECT qid, list_distinct({i.sql_content('query')}) AS t FROM questions)"


def best_sources(spark, sf_dir) -> DataFrame:
    """The best sources of each question, with their texts."""
    corpus, q = i.corpus(spark, sf_dir), i.questions(spark, sf_dir)
    best = ev.score_sources(corpus, None, q, i.NOW_YEAR).where(F.col("idx") <= fixed.DEFAULTS["max_sources"]).select("qid", "idx", "sid", "score")
    return best.join(corpus, "sid")


@query(_BEST + rf""", s AS (SELECT qid, sid, score, unnest(x) AS s, unnest(range(len(x))) AS k FROM (SELECT qid, sid, score, list_slice({i.sql_sentences('content')}, 1, 160) AS x FROM best WHERE length(content) >= 200)),
c AS (SELECT s.*, list_distinct({i.sql_content('s')}) AS w, t FROM s JOIN q USING (qid) WHERE length(s) BETWEEN 25 AND 400), b AS (SELECT *, len(list_intersect(w, t)) * 1.6 + CASE WHEN regexp_matches(s, '\d') THEN 0.7 ELSE 0 END + greatest(0, 1.0 - k * 0.015) + score * 0.8 AS base FROM c WHERE len(w) > 0)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(base, 9) DESC, sid, k)::INT AS rank, sid, k::INT AS i, md5(s) AS sentence, round(base, 6)::DOUBLE AS base FROM b WHERE base > 0 QUALIFY rank <= 96""")
def summary_candidates(spark, sf_dir):
    """The pool that a question's summary is chosen from."""
    pool = max(60, 8 * fixed.DEFAULTS["summary_sentences"])
    found = ev.summary_candidates(best_sources(spark, sf_dir), i.questions(spark, sf_dir)).where(F.col("rank") <= pool)
    return found.select("qid", "rank", "sid", "i", F.md5("sentence").alias("sentence"), F.round("base", 6).alias("base"))


@query(_BEST + rf""", s AS (SELECT qid, sid, unnest(x) AS s, unnest(range(len(x))) AS k FROM (SELECT qid, sid, list_slice({i.sql_sentences('content')}, 1, 200) AS x FROM best)),
c AS (SELECT s.*, list_distinct({i.sql_content('s')}) AS w, t FROM s JOIN q USING (qid) WHERE length(s) >= 20), b AS (SELECT *, len(list_intersect(w, t)) * 2.0 + CASE WHEN regexp_matches(s, '\d') THEN 0.8 ELSE 0 END - CASE WHEN length(s) > 300 THEN 1.0 ELSE 0 END + greatest(0, 1.2 - k * 0.02) AS score FROM c)
SELECT qid, sid, row_number() OVER (PARTITION BY qid, sid ORDER BY round(score, 9) DESC, k)::INT AS rank, k::INT AS i, round(score, 6)::DOUBLE AS score FROM b WHERE score > 0""")
def quote_scores(spark, sf_dir):
    return ev.quote_scores(best_sources(spark, sf_dir), i.questions(spark, sf_dir)).select("qid", "sid", "rank", "i", F.round("score", 6).alias("score"))


_SUMMARY = [
    (1, 1, 1, "Solid state batteries reach high energy density in laboratory cells"), (1, 2, 2, "However solid state batteries fail: energy density in laboratory cells is low"), (1, 3, 3, "Costs of production lines fall quickly"), (1, 4, 2, "Production lines cost much, but criticism of costs is misleading: costs fall quickly"), (1, 5, 1, "Solid state is a topic"),
    (2, 1, 1, "only one sentence"), (3, 1, 1, "alpha beta gamma delta epsilon"), (3, 2, 2, "not true: alpha beta gamma delta"), (3, 3, 3, "other words entirely here"),
]


@query("WITH " + i.values("t0", "qid, pos, source_idx, text", _SUMMARY) + f""", o AS (SELECT *, list_distinct({i.sql_content('text')}) AS w, regexp_matches(text, '(?i){fixed.OPPOSITION}') AS opp FROM t0), n AS (SELECT qid, count(*) AS n FROM o GROUP BY qid),
k AS (SELECT qid, list(t) AS topic FROM (SELECT qid, t, count(*) AS k FROM (SELECT qid, unnest(w) AS t FROM o) GROUP BY ALL) JOIN n USING (qid) WHERE k >= greatest(3, n * 0.5) GROUP BY qid), u AS (SELECT o.*, list_filter(w, lambda x: NOT list_contains(coalesce(topic, []), x)) AS v FROM o LEFT JOIN k ON o.qid = k.qid),
p AS (SELECT a.qid, a.pos AS pos_a, b.pos AS pos_b, list_sort(list_intersect(a.v, b.v)) AS shared FROM u a JOIN u b ON a.qid = b.qid AND a.pos < b.pos AND a.source_idx <> b.source_idx AND a.opp <> b.opp)
SELECT qid, pos_a, pos_b, array_to_string(list_slice(shared, 1, 6), ',') AS shared_terms, row_number() OVER (PARTITION BY qid ORDER BY pos_a, pos_b)::INT AS idx FROM p WHERE len(shared) >= 3 QUALIFY idx <= 3""")
def divergences(spark, sf_dir):
    return ev.divergences(i.table(spark, "qid int, pos int, source_idx int, text string", _SUMMARY)).select("qid", "pos_a", "pos_b", F.array_join("shared_terms", ",").alias("shared_terms"), "idx")


_ANCHORS = [(1, "登录", "nav", False), (2, "A long headline about batteries: part 2", "result item", True), (3, "sign in", "b_algo", False), (4, "Read our cookie policy", "footer", False), (5, "固态电池产业化进展", "sidebar ads", True), (6, "short", "main content", False)]


@query("WITH " + i.values("t0", "id, anchor, sig, heading", _ANCHORS) + f""" SELECT id, regexp_matches(anchor, '(?i){fixed.CONTROL_ANCHOR}') OR regexp_matches(anchor, '(?i){fixed.CONTROL_PART}') AS control, regexp_matches(sig, '(?i){fixed.RESULT_HINT}') AS result, regexp_matches(sig, '(?i){fixed.FRAME_HINT}') AS frame,
(CASE WHEN length(anchor) >= 12 THEN 4 ELSE 0 END + CASE WHEN length(anchor) >= 20 THEN 3 ELSE 0 END + CASE WHEN regexp_matches(anchor, '[一-鿿]') AND length(anchor) >= 6 THEN 3 ELSE 0 END + CASE WHEN regexp_matches(anchor, '{fixed.HEADLINE_MARKS}') THEN 1.5 ELSE 0 END + CASE WHEN heading THEN 6 ELSE 0 END)::DOUBLE AS headline,
(CASE WHEN regexp_matches(sig, '(?i){fixed.POSITIVE_HINT}') THEN 30 ELSE 0 END - CASE WHEN regexp_matches(sig, '(?i){fixed.NEGATIVE_HINT}') THEN 40 ELSE 0 END)::DOUBLE AS class_weight FROM t0""")
def page_hints(spark, sf_dir):
    a, sig = F.col("anchor"), F.col("sig")
    return i.table(spark, "id int, anchor string, sig string, heading boolean", _ANCHORS).select(
        "id", (a.rlike(f"(?i){fixed.CONTROL_ANCHOR}") | a.rlike(f"(?i){fixed.CONTROL_PART}")).alias("control"), sig.rlike(f"(?i){fixed.RESULT_HINT}").alias("result"), sig.rlike(f"(?i){fixed.FRAME_HINT}").alias("frame"),
        text.headline_score(a, F.col("heading")).alias("headline"), text.class_weight(sig).alias("class_weight"),
    )


from . import catalog_more  # noqa: E402,F401  registers the rest
