"""Inputs of the registered queries: views derived from the tables, and small literal tables, each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions import fixed, text, urls

NOW_YEAR = 2026


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    title = F.substring(F.coalesce(F.try_element_at(text.sentences(F.col("text")), F.lit(1)), F.lit("")), 1, 60)
    return docs.select(
        F.col("doc_id").alias("sid"), F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"), title.alias("title"),
        F.coalesce("text", F.lit("")).alias("content"), F.lit("").alias("snippet"), F.array("source").alias("engines"), F.lit("ok").alias("status"), F.lit("").alias("published"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.slice(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1), 1, 8)
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(words, " ").alias("query"))


EVENT_ENGINES = {"click": "bing_cn", "error": "nobody", "purchase": "arxiv", "signup": "github", "view": "baidu"}


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hits: the type is the engine, the page is the address, the user is the query."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), "url")
    n, q = pages.count(), read(spark, sf_dir, "benchmark").count()
    engine = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_ENGINES.items() for x in kv]), F.col("event_type"))
    own = read(spark, sf_dir, "events").select("event_id", "user_id", engine.alias("engine_id"), "props", (F.col("event_id") % n).alias("page"))
    place = F.row_number().over(W.partitionBy("engine_id", "user_id").orderBy("event_id"))
    return own.withColumn("position", place).join(pages, "page").select(
        (F.col("user_id") % q).alias("qid"), F.col("event_id").alias("ord"), "engine_id", F.concat(F.lit("q"), (F.col("event_id") % 3).cast("string")).alias("query"), "url",
        F.regexp_replace("url", "[^a-zA-Z]+", " ").alias("title"), F.concat("props", F.lit(" the page "), F.regexp_replace("url", "[^a-zA-Z]+", " ")).alias("snippet"), "position",
    )


# ---- the same in SQL --------------------------------------------------------------------------------------------------


def lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(lit, x)) + "]"
    return "'" + x.replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression with literal rows."""
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


STOP = lit(fixed.STOP_WORDS)


def sql_tokens(x: str) -> str:
    pairs = f"flatten(list_transform(regexp_extract_all({x}, '[一-鿿]+'), lambda r: CASE WHEN length(r) <= 2 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))"
    words = rf"list_filter(list_transform(regexp_extract_all({x}, '[a-zA-Z][a-zA-Z0-9_+#.\-]*'), lambda w: regexp_replace(lower(w), '^[._\-]+|[._\-]+$', '', 'g')), lambda w: length(w) >= 2 AND NOT list_contains({STOP}, w))"
    return f"list_concat({pairs}, {words})"


def sql_content(x: str) -> str:
    return f"list_filter({sql_tokens(x)}, lambda t: NOT list_contains({STOP}, t) AND NOT regexp_full_match(t, '[0-9]+'))"


def sql_squeeze(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^ | $', '', 'g')"


def sql_sentences(x: str) -> str:
    marked = rf"regexp_replace(regexp_replace({x}, '([。！？!?；;])\s*', '\1' || chr(10), 'g'), '([.!?])\s+([A-Z])', '\1' || chr(10) || '\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(10)), lambda s: {sql_squeeze('s')}), lambda s: length(s) >= 8)"


def sql_domain(url: str) -> str:
    host = rf"lower(regexp_replace(regexp_replace(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', ''))"
    for p in ("www", "m", "mobile", "wap"):
        host = rf"regexp_replace({host}, '^{p}\.', '')"
    return host


def sql_normalize(url: str) -> str:
    """For addresses without escapes in their queries, which is what the pages have."""
    scheme = rf"lower(regexp_extract({url}, '^([a-zA-Z][a-zA-Z0-9+.\-]*)://', 1))"
    port = rf"regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*:(\d+)(?:[/?#]|$)', 1)"
    path = rf"regexp_replace(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"
    query = rf"array_to_string(list_sort(list_filter(string_split(regexp_extract({url}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_extract(p, '=(.*)$', 1) <> '' AND NOT regexp_matches(p, '(?i){fixed.TRACKING}'))), '&')"
    return f"CASE WHEN {scheme} IN ('http', 'https') THEN 'https' ELSE {scheme} END || '://' || {sql_domain(url)} || CASE WHEN {port} IN ('', '80', '443') THEN '' ELSE ':' || {port} END || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"


def sql_authority(d: str) -> str:
    table = "MAP {" + ", ".join(f"{lit(k)}: {v!r}" for k, v in fixed.AUTHORITY_DOMAIN.items()) + "}"
    parent = f"(list_filter(list_transform(range(2, len(string_split({d}, '.'))), lambda i: {table}[array_to_string(string_split({d}, '.')[i:], '.')]), lambda v: v IS NOT NULL))[1]"
    endings = " ".join(f"WHEN {d} LIKE {lit('%' + e)} THEN {v!r}" for e, v in fixed.AUTHORITY_ENDING)
    return f"CASE WHEN {d} = '' THEN {fixed.AUTHORITY_NONE} WHEN {table}[{d}] IS NOT NULL THEN {table}[{d}] WHEN {parent} IS NOT NULL THEN {parent} * {fixed.PARENT_SHARE} {endings} WHEN regexp_matches({d}, '(?i){fixed.LOW_QUALITY}') THEN {fixed.AUTHORITY_LOW} ELSE {fixed.AUTHORITY_OTHER} END::DOUBLE"


CORPUS = f"corpus AS (SELECT doc_id AS sid, 'https://' || source || '.example.org/' || doc_id AS url, substr(coalesce(({sql_sentences('text')})[1], ''), 1, 60) AS title, coalesce(text, '') AS content, source FROM documents)"
QUESTIONS = r"questions AS (SELECT item_id AS qid, array_to_string(list_slice(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1, 8), ' ') AS query FROM benchmark)"
TERMS = f"terms AS (SELECT qid, unnest({sql_content('query')}) AS term FROM questions)"
HITS = f"""hits AS (
  SELECT user_id % (SELECT count(*) FROM benchmark) AS qid, event_id AS ord, engine_id, 'q' || (event_id % 3) AS query, url, regexp_replace(url, '[^a-zA-Z]+', ' ', 'g') AS title,
         props || ' the page ' || regexp_replace(url, '[^a-zA-Z]+', ' ', 'g') AS snippet, row_number() OVER (PARTITION BY engine_id, user_id ORDER BY event_id) AS position
  FROM (SELECT *, MAP {{{', '.join(f'{lit(k)}: {lit(v)}' for k, v in EVENT_ENGINES.items())}}}[event_type] AS engine_id, event_id % (SELECT count(*) FROM pages) AS page FROM events) e JOIN pages ON page_id = page
)"""
BM25 = f"""body AS (
  SELECT sid, {sql_tokens("repeat(title || ' ', 3) || content")} AS tokens FROM corpus
), cand AS (
  SELECT DISTINCT qid, sid FROM (SELECT sid, unnest(list_distinct(tokens)) AS term FROM body) JOIN terms USING (term)
), lens AS (
  SELECT qid, sid, len(tokens) AS dl FROM cand JOIN body USING (sid)
), stats AS (
  SELECT qid, count(*) AS n, avg(dl) AS avgdl FROM lens GROUP BY qid
), tf AS (
  SELECT qid, sid, term, f, dl FROM (SELECT sid, term, count(*) AS f FROM (SELECT sid, unnest(tokens) AS term FROM body) GROUP BY ALL) JOIN (SELECT DISTINCT qid, term FROM terms) USING (term) JOIN lens USING (qid, sid)
), df AS (
  SELECT qid, term, count(*) AS df FROM tf GROUP BY ALL
), reps AS (
  SELECT qid, term, count(*) AS r FROM terms GROUP BY ALL
), bm AS (
  SELECT qid, sid, sum(r * ln(1 + (n - df + 0.5) / (df + 0.5)) * (f * 2.5) / (f + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS bm25
  FROM tf JOIN df USING (qid, term) JOIN reps USING (qid, term) JOIN stats USING (qid) GROUP BY ALL
)"""
SCORED = f"""fact AS (
  SELECT sid, {sql_authority('d')} AS authority, 0.5::DOUBLE AS freshness, least(length(content), 8000)::DOUBLE AS chars FROM (SELECT *, {sql_domain('url')} AS d FROM corpus)
), matched AS (
  SELECT DISTINCT qid, sid FROM (SELECT sid, unnest(list_distinct({sql_tokens("title || ' ' || substr(content, 1, 4000)")})) AS term FROM corpus) JOIN terms USING (term)
), rel AS (
  SELECT bm.qid, bm.sid, bm25, CASE WHEN matched.sid IS NULL THEN bm25 * 0.15 ELSE bm25 END AS rel, authority, freshness, chars
  FROM bm LEFT JOIN matched ON bm.qid = matched.qid AND bm.sid = matched.sid JOIN fact ON bm.sid = fact.sid
), parts AS (
  SELECT *, CASE WHEN max(rel) OVER w - min(rel) OVER w < 1e-9 THEN 0.5 ELSE (rel - min(rel) OVER w) / (max(rel) OVER w - min(rel) OVER w) END AS relevance,
         CASE WHEN max(chars) OVER w - min(chars) OVER w < 1e-9 THEN 0.5 ELSE (chars - min(chars) OVER w) / (max(chars) OVER w - min(chars) OVER w) END AS depth, 0.5::DOUBLE AS corroboration
  FROM rel WINDOW w AS (PARTITION BY qid)
), scored AS (
  SELECT *, 1.0 * relevance + 0.45 * authority + 0.2 * freshness + 0.25 * depth + 0.2 * corroboration AS score FROM parts
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, sid) AS idx FROM scored
)"""


# ---- literal tables ---------------------------------------------------------------------------------------------------


def table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


MIXED_TEXTS = [
    (1, "固态电池的能量密度 is 500 Wh/kg, node.js and C++17 -- the A.I. era"), (2, "电解质很重要。固态电池电解质!真的?是的;Why not? Because it fails. \nNew line here"), (3, ""), (4, "日本語テキスト 漢字 mixed_WITH-latin. x y z"), (5, "全固态电池产业化加速,固态电池技术进展,多固态电池中试,条固态电池产线"),
    (6, "新型固态电池技术路线,国产固态电池中试线,某固态电池产能"),
]
URL_ROWS = [
    (1, "HTTP://User@WWW.Example.com:80/a/b/?b=2&a=1&utm_source=x#frag"), (2, "https://m.mobile.example.com:8443//x//"), (3, "https://example.com?format=json&id=7&empty="), (4, "https://arxiv.org/abs/1"), (5, "https://news.bbc.co.uk/x"),
    (6, "https://sub.deep.github.com/"), (7, "https://www.city.gov/about"), (8, "http://content12.com/x.js"), (9, "https://foo.ac.uk/login"), (10, "ftp://example.org/file"), (11, "https://docin.net/p"), (12, ""),
    (13, "https://www.bing.com/ck/a?!&&p=1&u=a1aHR0cHM6Ly9leGFtcGxlLmNvbS9wYWdlP2lkPTE&ntb=1"), (14, "https://csdn.net/question"), (15, "https://x.example.edu.cn/"),
]
QUESTION_ROWS = [
    (1, "请问固态电池是什么?", None), (2, "how to install docker on linux", None), (3, "site:github.com spark", None), (4, "最新 新闻 进展", None), (5, "RAG 的局限", None), (6, "what is the meaning of life", None), (7, "plain words only", None),
    (8, "苹果财报 营收", "social"), (9, "reddit opinion", "nothing"), (10, "survey of transformers", "privacy"), (11, "python vs java", None), (12, "固态电池的优缺点", None), (13, "please explain BM25 ranking?", None), (14, '"exact phrase" search', None), (15, "为什么天空是蓝色的", None),
]
