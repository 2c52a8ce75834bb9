"""Set operators over hits, sources and questions. All are keyed by question, so one question is a batch of one row.

Columns: sources(qid, sid, url, title, content, snippet, engines array<string>, status, published); questions(qid, query);
hits(qid, ord, engine_id, query, url, title, snippet, position). sid and ord are total orders that break ties.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions import fixed, text, urls


# ---- static tables ----------------------------------------------------------------------------------------------------


def engines_table(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, *e) for i, e in enumerate(fixed.ENGINES)]
    return spark.createDataFrame(rows, "ord int, id string, name string, category string, weight double, tier int, timeout double, english_only boolean")


def facets_table(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, f, label, zh, en, words) for i, (f, label, zh, en, words) in enumerate(fixed.FACETS)]
    return spark.createDataFrame(rows, "ord int, facet string, label string, zh array<string>, en array<string>, words array<string>")


def engine_weights(engines: DataFrame, overrides: DataFrame) -> DataFrame:
    """overrides(id, w string): known engines get the new weight if it is a number; the rest is ignored."""
    new = overrides.select("id", F.col("w").try_cast("double").alias("new"))
    return engines.join(new, "id", "left").withColumn("weight", F.coalesce("new", "weight")).drop("new")


# ---- intent and routing -----------------------------------------------------------------------------------------------


def intent(query: Column, hint: Column | None = None) -> Column:
    """A known hint, else advanced syntax, else the first intent any of whose words is in the query, else general."""
    low = F.lower(query)
    found = F.lit(None).cast("string")
    for name, words in reversed(fixed.INTENT_WORDS):
        found = F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(name)).otherwise(found)
    found = F.when(query.rlike(f"(?i){fixed.ADVANCED}"), F.lit("advanced")).otherwise(F.coalesce(found, F.lit("general")))
    return found if hint is None else F.when(hint.isin(list(fixed.INTENT_ENGINES)), hint).otherwise(found)


def route(questions: DataFrame) -> DataFrame:
    """questions(qid, query, hint, include array, exclude array) to rows (qid, pos, engine_id): the intent's engines, those
    included after them, those excluded left out; the fallback engine if none is left."""
    spark = questions.sparkSession
    lists = spark.createDataFrame([(k, v) for k, v in fixed.INTENT_ENGINES.items()], "intent string, ids array<string>")
    known = F.array(*[F.lit(e[0]) for e in fixed.ENGINES])
    wanted = questions.withColumn("intent", intent(F.col("query"), F.col("hint"))).join(F.broadcast(lists), "intent")
    empty = F.array().cast("array<string>")
    ids = F.array_distinct(F.concat("ids", F.array_intersect(F.coalesce("include", empty), known)))
    left = F.filter(ids, lambda e: ~F.array_contains(F.coalesce("exclude", empty), e))
    left = F.when(F.size(left) == 0, F.array(F.lit(fixed.FALLBACK_ENGINE))).otherwise(left)
    return wanted.select("qid", "intent", F.posexplode(left).alias("pos", "engine_id")).withColumn("pos", F.col("pos") + 1)


def search_tasks(subqueries: DataFrame, routes: DataFrame, engines: DataFrame) -> DataFrame:
    """Every sub-query with every engine of its question; engines that read English only get what is not CJK, if two characters are left."""
    both = subqueries.join(routes.select("qid", "pos", "engine_id"), "qid").join(F.broadcast(engines.select(F.col("id").alias("engine_id"), "timeout", "english_only")), "engine_id")
    sent = F.when(F.col("english_only"), text.strip_cjk(F.col("text"))).otherwise(F.col("text"))
    return both.withColumn("sent", sent).where(~F.col("english_only") | (F.length("sent") >= 2))


# ---- authority, ranking of hits ---------------------------------------------------------------------------------------


def authority(df: DataFrame, domain: str = "domain", out: str = "authority") -> DataFrame:
    """Adds the authority of a domain: its own, a parent's (a little less), its ending's, low quality, or a middle value. The
    tables are constants, so they are map literals: no join."""
    table = F.create_map(*[F.lit(x) for k, v in fixed.AUTHORITY_DOMAIN.items() for x in (k, v)])
    d = F.lower(F.coalesce(F.col(domain), F.lit("")))
    parts = F.split(d, r"\.")
    parents = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    parents = F.when(F.size(parts) > 2, parents).otherwise(F.array().cast("array<string>"))
    parent = F.try_element_at(F.filter(F.transform(parents, lambda p: F.try_element_at(table, p)), lambda v: v.isNotNull()), F.lit(1))
    value = F.coalesce(F.try_element_at(table, d), parent * fixed.PARENT_SHARE)
    for ending, v in fixed.AUTHORITY_ENDING:
        value = F.coalesce(value, F.when(F.endswith(d, F.lit(ending)), v))
    value = F.coalesce(value, F.when(d.rlike(f"(?i){fixed.LOW_QUALITY}"), fixed.AUTHORITY_LOW), F.lit(fixed.AUTHORITY_OTHER))
    return df.withColumn(out, F.when(d == "", fixed.AUTHORITY_NONE).otherwise(value))


def group_hits(hits: DataFrame) -> DataFrame:
    """Hits of one address: engines, queries, best place, and the hit with the longest snippet (the first of these)."""
    keyed = hits.withColumn("key", urls.normalize(F.col("url"))).withColumn("key", F.when(F.col("key") == "", F.col("url")).otherwise(F.col("key"))).where("key <> ''")
    best = F.max_by(F.struct("url", "title", "snippet", "ord"), F.struct(F.length("snippet").alias("n"), (-F.col("ord")).alias("o")))
    place = F.when(F.coalesce("position", F.lit(0)) == 0, 999).otherwise(F.col("position"))
    return keyed.groupBy("qid", "key").agg(F.array_sort(F.collect_set("engine_id")).alias("engines"), F.countDistinct("query").alias("n_queries"), F.min(place).alias("position"), best.alias("b"), F.min("ord").alias("first")).select("qid", "key", "engines", "n_queries", "position", "first", "b.url", "b.title", "b.snippet")


def rank_hits(hits: DataFrame, questions: DataFrame, engines: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Addresses of each question by score: engine weight, agreement of engines, place, authority, words in common."""
    found = group_hits(hits)
    if seen is not None:
        found = found.join(seen, ["qid", "key"], "left_anti")
    weights = F.create_map(*[F.lit(x) for e in fixed.ENGINES for x in (e[0], e[3])]) if engines is None else None
    if weights is None:
        by = engines.agg(F.map_from_entries(F.collect_list(F.struct("id", "weight"))).alias("weights"))
        found = found.crossJoin(F.broadcast(by))  # one row
        weights = F.col("weights")
    found = authority(found.withColumn("domain", urls.domain(F.col("url"))))
    q = questions.select("qid", F.array_distinct(text.content_tokens(F.col("query"))).alias("terms"))
    found = found.join(q, "qid")
    weight = F.coalesce(F.array_max(F.transform(F.col("engines"), lambda e: F.try_element_at(weights, e))), F.lit(fixed.UNKNOWN_WEIGHT))
    common = lambda c: F.size(F.array_intersect(text.token_set(F.col(c)), F.col("terms"))) / F.greatest(F.size("terms"), F.lit(1))
    match = F.when(F.size("terms") > 0, 3.0 * common("title") + common("snippet")).otherwise(0.0)
    score = 3.0 * weight + 2.2 * (F.size("engines") - 1) + F.greatest(F.lit(0.0), 2.5 - F.col("position") * 0.18) + 2.0 * F.col("authority") + match + 0.8 * (F.col("n_queries") - 1)
    ranked = found.withColumn("score", score)
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "first"))).select("qid", "rank", "key", "url", "title", "snippet", "engines", "score")


def top_k(df: DataFrame, by: list, k: int, group: str = "qid", out: str = "idx") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(group).orderBy(*by))).where(F.col(out) <= k)


# ---- relevance and score of sources -----------------------------------------------------------------------------------


def best_text() -> Column:
    return F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.coalesce("snippet", F.lit("")))


def postings(corpus: DataFrame, questions: DataFrame) -> DataFrame:
    """(sid, dl, term, f, head) for the questions' terms: how often a source has the term (its title counts three times), the
    source's tokens, and whether the term is in its title or the head of its text. Texts are tokenised once, whatever the
    number of questions; only counts of query terms leave the scan."""
    whole, start = best_text(), F.substring(best_text(), 1, fixed.MATCH_CHARS)
    own = corpus.select("sid", text.tokenize(F.concat(F.repeat(F.concat(F.col("title"), F.lit(" ")), 3), whole)).alias("tokens"), (F.length(whole) > fixed.MATCH_CHARS).alias("long"), "title", start.alias("start"))
    some = F.when(F.col("long"), text.token_set(F.concat(F.col("title"), F.lit(" "), F.col("start")))).otherwise(F.array().cast("array<string>"))
    each = F.concat(F.transform("tokens", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), (~F.col("long")).alias("head"))), F.transform(some, lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(True).alias("head"))))
    rows = own.select("sid", F.size("tokens").alias("dl"), F.explode(each).alias("x")).select("sid", "dl", "x.*").join(query_terms(questions).select("term").distinct(), "term", "left_semi")
    return rows.groupBy("sid", "dl", "term").agg(F.sum("n").alias("f"), F.max("head").alias("head"))


def matched(corpus: DataFrame, candidates: DataFrame | None, questions: DataFrame) -> DataFrame:
    """(qid, sid, bm25, head) for each candidate (qid, sid), or without candidates for each source that has a term of the
    question; the collection of a question is its own candidates. head: whether a term is in the title or the text's head. A
    repeated query term counts again."""
    terms = query_terms(questions).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("repeats"))
    found = postings(corpus, questions)
    tf = found.join(terms, "term")
    if candidates is not None:
        own = candidates.select("qid", "sid").distinct()
        tf = tf.join(own, ["qid", "sid"])
    # A word that the head's end cuts through may be in the head alone; then it says nothing but that.
    pairs = tf.groupBy("qid", "sid", "dl").agg(F.collect_list(F.when(F.col("f") > 0, F.struct("term", "f", "repeats"))).alias("terms"), F.max("head").alias("head"))
    if candidates is None:
        pairs = pairs.where(F.size("terms") > 0)
    else:  # those without a term count too
        size = corpus.select("sid", F.size(text.tokenize(F.concat(F.repeat(F.concat(F.col("title"), F.lit(" ")), 3), best_text()))).alias("dl"))
        pairs = own.join(size, "sid").join(pairs.drop("dl"), ["qid", "sid"], "left")
    # A row for each question; a map of the question's own few terms.
    stats = pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = tf.where("f > 0").groupBy("qid", "term").agg(F.count(F.lit(1)).alias("df")).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
    scored = pairs.join(stats.join(df, "qid", "left"), "qid")
    k1, b = fixed.BM25_K1, fixed.BM25_B

    def part(x):
        df = F.try_element_at("df", x["term"])
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return x["repeats"] * idf * (x["f"] * (k1 + 1)) / (x["f"] + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))

    # In the terms' order, so that sums do not depend on the rows' order.
    total = F.aggregate(F.transform(F.array_sort("terms"), part), F.lit(0.0), lambda a, x: a + x)
    return scored.select("qid", "sid", F.coalesce(total, F.lit(0.0)).alias("bm25"), F.coalesce("head", F.lit(False)).alias("head"))


def bm25(corpus: DataFrame, candidates: DataFrame | None, questions: DataFrame) -> DataFrame:
    """(qid, sid, bm25): see matched()."""
    return matched(corpus, candidates, questions).drop("head")


def candidates_of(corpus: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, sid): the sources with a query term in their title or text. A join on terms, no pairs without one."""
    terms = query_terms(questions).distinct()
    own = corpus.select("sid", F.explode(text.token_set(F.concat(F.col("title"), F.lit(" "), best_text()))).alias("term"))
    return own.join(terms, "term").select("qid", "sid").distinct()


def query_terms(questions: DataFrame) -> DataFrame:
    """(qid, term), repeats kept: the query's content tokens, else its first twenty tokens."""
    q = questions.select("qid", text.content_tokens(F.col("query")).alias("c"), F.slice(text.tokenize(F.col("query")), 1, 20).alias("t"))
    return q.select("qid", F.explode(F.when(F.size("c") > 0, F.col("c")).otherwise(F.col("t"))).alias("term"))


def scaled(df: DataFrame, c: str, out: str, group: str = "qid") -> DataFrame:
    """Adds c scaled to 0..1 within the group; 0.5 if all are equal. The ends are aggregates, joined back."""
    ends = df.groupBy(F.col(group).alias("__g")).agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    value = F.when(span < 1e-9, 0.5).otherwise((F.col(c) - F.col("__lo")) / F.when(span < 1e-9, 1.0).otherwise(span))
    return df.join(ends, F.col(group).eqNullSafe(F.col("__g"))).withColumn(out, value).drop("__g", "__lo", "__hi")


def score_sources(corpus: DataFrame, candidates: DataFrame | None, questions: DataFrame, now_year: int, weights: dict | None = None) -> DataFrame:
    """(qid, sid) with relevance, authority, freshness, depth, corroboration, score and idx (1 is the best of its question).

    Texts stay behind: what a score needs of a source is computed once, and only numbers meet questions. Least and largest
    values are aggregates with a row for each question; a filter on idx lets each task keep its own best only."""
    w = fixed.WEIGHTS | (weights or {})
    facts = authority(corpus.withColumn("domain", urls.domain(F.col("url")))).select(
        "sid", "authority", text.freshness(F.col("published"), now_year).alias("freshness"), F.least(F.length(F.coalesce("content", F.lit(""))), F.lit(fixed.DEPTH_CHARS)).cast("double").alias("chars"),
        F.size(F.array_distinct("engines")).cast("double").alias("n_engines"),
    )
    rel = matched(corpus, candidates, questions).join(facts, "sid")
    rel = rel.withColumn("rel", F.when(F.col("head"), F.col("bm25")).otherwise(F.col("bm25") * fixed.MISS_FACTOR))
    ends = rel.groupBy("qid").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("rel", "chars", "n_engines") for f in (F.min, F.max)])

    def between(c: str) -> Column:
        low, high = F.col(f"{c}_min"), F.col(f"{c}_max")
        return F.when(high - low < 1e-9, 0.5).otherwise((F.col(c) - low) / F.when(high - low < 1e-9, 1.0).otherwise(high - low))

    done = rel.join(ends, "qid").withColumns({"relevance": between("rel"), "depth": between("chars"), "corroboration": between("n_engines")})
    done = done.withColumn("score", sum((F.lit(float(w[k])) * F.col(k) for k in ("relevance", "authority", "freshness", "depth", "corroboration")), F.lit(0.0)))
    done = done.withColumn("idx", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "sid")))
    return done.select("qid", "idx", "sid", "bm25", "relevance", "authority", "freshness", "depth", "corroboration", "score")


# ---- fingerprints and near duplicates ---------------------------------------------------------------------------------


def token_prints(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, fingerprint) of keys with tokens: a long whose bits are the majority of the tokens' hash bits, weighted by frequency.

    Each occurrence of a token votes, so that the votes of a key are summed in the task that reads its rows. Ones are counted in
    32 longs, bit b in the lower and bit b + 32 in the upper half of one: right for keys of fewer than 2^32 tokens."""
    hi, lo = text.token_bits(F.col("token"))
    each = df.select(key, F.explode(tokens).alias("token")).select(key, F.shiftleft(hi, 32).bitwiseOR(lo).alias("hash"))
    ones = lambda b: F.sum(F.shiftrightunsigned("hash", b).bitwiseAND(F.lit(1 << 32 | 1)))
    sums = each.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[ones(b).alias(f"b{b}") for b in range(32)])
    bits = F.lit(0).cast("long")
    for b in range(64):
        half = F.col(f"b{b}").bitwiseAND(F.lit((1 << 32) - 1)) if b < 32 else F.shiftrightunsigned(f"b{b - 32}", 32)
        bits = bits.bitwiseOR(F.when(2 * half > F.col("n"), F.lit((1 << b) - (1 << 64 if b == 63 else 0))).otherwise(F.lit(0)).cast("long"))
    return sums.select(key, bits.alias("fingerprint"))


def simhash(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, fingerprint) of all keys: 0 without tokens."""
    return df.select(key).distinct().join(token_prints(df, key, tokens), key, "left").select(key, F.coalesce("fingerprint", F.lit(0).cast("long")).alias("fingerprint"))


def near_pairs(prints: DataFrame, distance: int = 6, equal: int = 3) -> DataFrame:
    """Pairs (a, b) of different fingerprints at most `distance` bits apart, a < b, and their distance. prints(fingerprint, ...):
    distinct values; other columns come along as a_<column> and b_<column>.

    Of distance + equal blocks of bits at least `equal` are the same, so choices of so many blocks are join keys and no pair is
    lost. A pair is taken at the choice of its first equal blocks only, so it comes once and no candidates are gathered. A key
    has 64 * equal / (distance + equal) bits: more equal blocks give fewer chance candidates and more keys."""
    blocks = distance + equal
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    f, more = F.col("fingerprint"), [c for c in prints.columns if c != "fingerprint"]
    signed = lambda m: F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long")
    masks = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    keys = F.array(*[F.struct(F.lit(sum(1 << i for i in chosen)).alias("k"), f.bitwiseAND(signed(sum(masks[i] for i in chosen))).alias("v")) for chosen in combinations(range(blocks), equal)])
    side = lambda c: prints.select(f.alias(c), *[F.col(m).alias(f"{c}_{m}") for m in more], F.explode(keys).alias("x")).select(c, *[f"{c}_{m}" for m in more], "x.k", "x.v")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    others = F.col("k")  # the equal blocks that the key leaves out: none may come before its last one
    for i, m in enumerate(masks):
        others = others.bitwiseXOR(F.when(apart.bitwiseAND(signed(m)) == 0, F.lit(1 << i)).otherwise(F.lit(0)))
    first = (others == 0) | (others.bitwiseAND(-others) > F.col("k"))
    pairs = side("a").join(side("b"), ["k", "v"]).where((F.col("a") < F.col("b")) & (text.hamming(F.col("a"), F.col("b")) <= distance)).where(first)
    return pairs.select("a", "b", *[f"{c}_{m}" for m in more for c in "ab"], text.hamming(F.col("a"), F.col("b")).alias("distance"))


# ---- coverage ---------------------------------------------------------------------------------------------------------


def facet_coverage(texts: DataFrame, column: str = "text", group: str = "qid") -> DataFrame:
    """(group, facet, hits): how many of a facet's words occur anywhere in the group's texts."""
    found = [F.max(F.contains(F.lower(F.col(column)), F.lit(w.lower())).cast("int")).alias(f"f{i}_{j}") for i, f in enumerate(fixed.FACETS) for j, w in enumerate(f[4])]
    wide = texts.groupBy(group).agg(*found)
    rows = F.array(*[F.struct(F.lit(f[0]).alias("facet"), F.lit(i + 1).alias("ord"), sum((F.coalesce(F.col(f"f{i}_{j}"), F.lit(0)) for j in range(len(f[4]))), F.lit(0)).cast("long").alias("hits")) for i, f in enumerate(fixed.FACETS)])
    return wide.select(group, F.explode(rows).alias("x")).select(group, "x.*")


def uncovered(coverage: DataFrame, threshold: int = 1) -> DataFrame:
    return coverage.where(F.col("hits") < threshold)


def empty_facets(coverage: DataFrame, intents: DataFrame) -> DataFrame:
    """Facets without evidence, those that matter to the question's intent first. intents(qid, intent)."""
    order = coverage.sparkSession.createDataFrame([(k, f, i + 1) for k, v in fixed.INTENT_FACETS.items() for i, f in enumerate(v)], "intent string, facet string, prio int")
    known = F.when(F.col("intent").isin(list(fixed.INTENT_FACETS)), F.col("intent")).otherwise("general")
    gaps = uncovered(coverage).join(intents.withColumn("intent", known), "qid").join(F.broadcast(order), ["intent", "facet"], "left")
    return gaps.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy(F.coalesce("prio", F.lit(100)), "ord"))).select("qid", "facet", "pos")


def coverage_report(sources: DataFrame, now_year: int) -> DataFrame:
    """One row for each question about its evidence. Texts of 200 characters or more count as content."""
    own = sources.withColumns({"chars": F.length(F.coalesce("content", F.lit(""))), "domain": urls.domain(F.col("url")), "year": text.year_of(F.col("published"), now_year)})
    own = own.withColumn("full", (F.col("status") == "ok") & (F.col("chars") >= 200))
    only = lambda c: F.when(F.col("full"), F.col(c))
    totals = own.groupBy("qid").agg(
        F.count(F.lit(1)).alias("sources_total"), F.count_if("full").alias("sources_with_content"), F.countDistinct(F.when(F.col("full") & (F.col("domain") != ""), F.col("domain"))).alias("distinct_domains"),
        F.coalesce(F.floor(F.avg(only("chars"))), F.lit(0)).cast("long").alias("avg_chars"), F.coalesce(F.sum(only("chars")), F.lit(0)).alias("total_chars"), F.min(only("year")).alias("year_min"), F.max(only("year")).alias("year_max"),
    )
    counts = own.where("full").groupBy("qid", "domain").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("first"))
    top = top_k(counts, [F.desc("n"), "first"], 8).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "domain", "n"))), lambda x: F.concat(x["domain"], F.lit("="), x["n"])), ",").alias("top_domains"))
    return totals.join(top, "qid", "left").withColumn("top_domains", F.coalesce("top_domains", F.lit("")))


def engine_stats(calls: DataFrame) -> DataFrame:
    """calls(qid, engine_id, hits, error, ms) summed; a call without hits is no error by itself."""
    return calls.groupBy("engine_id").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("calls"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), F.sum("ms").alias("ms"))


def fresh_cache(cache: DataFrame, now: float, ttl: float = 900) -> DataFrame:
    """The newest response of each address that is not older than ttl."""
    live = cache.where(F.col("ts") >= F.lit(now - ttl))
    return live.groupBy("url_sha1").agg(F.max_by(F.struct("ts", "body"), "ts").alias("x")).select("url_sha1", "x.*")


# ---- term discovery ---------------------------------------------------------------------------------------------------


def entropy(counts: DataFrame, group: list[str], n: str, out: str) -> DataFrame:
    total = F.sum(n).over(W.partitionBy(*group))
    p = F.col(n) / F.col("total")
    return counts.withColumn("total", total).groupBy(*group).agg((-F.sum(p * F.log(p))).alias(out))


def discover_terms(texts: DataFrame, column: str = "text", group: str = "qid", min_freq: int = 2, min_boundary: float = 0.8, sizes=(2, 3, 4, 5, 6)) -> DataFrame:
    """CJK n-grams whose neighbours on both sides vary: (group, term, freq, boundary, score)."""
    grams = texts.select(group, F.explode(text.cjk_ngrams(F.col(column), sizes)).alias("g")).select(group, "g.*")
    freq = grams.groupBy(group, "term").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_freq)
    side = lambda c: entropy(grams.where(F.col(c).isNotNull()).groupBy(group, "term", c).agg(F.count(F.lit(1)).alias("k")), [group, "term"], "k", f"h_{c}")
    both = freq.join(side("left"), [group, "term"], "left").join(side("right"), [group, "term"], "left")
    both = both.withColumn("boundary", F.least(F.coalesce("h_left", F.lit(0.0)), F.coalesce("h_right", F.lit(0.0))))
    n = F.length("term")
    need = F.when(n >= 3, min_boundary).otherwise(min_boundary * 0.75)
    score = F.col("freq") * (1.0 + F.least(n, F.lit(6)) / 6.0) * (1.0 + F.col("boundary"))
    return both.where(F.col("boundary") >= need).select(group, "term", "freq", "boundary", score.alias("score"))


# ---- sentences --------------------------------------------------------------------------------------------------------


def summary_candidates(sources: DataFrame, questions: DataFrame) -> DataFrame:
    """sources(qid, sid, status, content, score) to sentences with their base value, ranked in each question."""
    q = questions.select("qid", F.array_distinct(text.content_tokens(F.col("query"))).alias("terms"))
    own = sources.where((F.col("status") == "ok") & (F.length("content") >= 200))
    each = own.select("qid", "sid", "score", F.posexplode(F.slice(text.sentences(F.col("content")), 1, 160)).alias("i", "sentence")).where(F.length("sentence").between(25, 400))
    each = each.join(q, "qid").withColumn("tokens", F.array_distinct(text.content_tokens(F.col("sentence")))).where(F.size("tokens") > 0)
    base = F.size(F.array_intersect("tokens", "terms")) * 1.6 + F.when(F.col("sentence").rlike(r"\d"), 0.7).otherwise(0.0) + F.greatest(F.lit(0.0), 1.0 - F.col("i") * 0.015) + F.col("score") * 0.8
    each = each.withColumn("base", base).where("base > 0")
    return each.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("base", 9)), "sid", "i"))).select("qid", "rank", "sid", "i", "sentence", "tokens", "base")


def quote_scores(sources: DataFrame, questions: DataFrame) -> DataFrame:
    """Sentences of each source by how well they serve as quotes."""
    q = questions.select("qid", F.array_distinct(text.content_tokens(F.col("query"))).alias("terms"))
    each = sources.select("qid", "sid", F.posexplode(F.slice(text.sentences(F.col("content")), 1, 200)).alias("i", "sentence")).where(F.length("sentence") >= 20).join(q, "qid")
    overlap = F.size(F.array_intersect(F.array_distinct(text.content_tokens(F.col("sentence"))), F.col("terms")))
    score = overlap * 2.0 + F.when(F.col("sentence").rlike(r"\d"), 0.8).otherwise(0.0) - F.when(F.length("sentence") > 300, 1.0).otherwise(0.0) + F.greatest(F.lit(0.0), 1.2 - F.col("i") * 0.02)
    each = each.withColumn("score", score).where("score > 0")
    return each.withColumn("rank", F.row_number().over(W.partitionBy("qid", "sid").orderBy(F.desc(F.round("score", 9)), "i"))).select("qid", "sid", "rank", "i", "sentence", "score")


def divergences(summary: DataFrame, min_shared: int = 3, most: int = 3) -> DataFrame:
    """summary(qid, pos, source_idx, text): pairs of sentences from two sources about the same particular words, where one
    opposes and the other does not. Words in half of the sentences (three at least) are the topic, not the point at issue."""
    own = summary.select("qid", "pos", "source_idx", "text", F.array_distinct(text.content_tokens(F.col("text"))).alias("tokens"), text.opposes(F.col("text")).alias("opposition"))
    n = own.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    topic = own.select("qid", F.explode("tokens").alias("t")).groupBy("qid", "t").agg(F.count(F.lit(1)).alias("k")).join(n, "qid").where(F.col("k") >= F.greatest(F.lit(3.0), F.col("n") * 0.5)).groupBy("qid").agg(F.collect_set("t").alias("topic"))
    own = own.join(topic, "qid", "left").withColumn("tokens", F.array_except("tokens", F.coalesce("topic", F.array().cast("array<string>"))))
    a, b = own.alias("a"), own.alias("b")
    pair = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.pos") < F.col("b.pos")) & (F.col("a.source_idx") != F.col("b.source_idx")) & (F.col("a.opposition") != F.col("b.opposition")))
    pair = pair.withColumn("shared", F.array_sort(F.array_intersect("a.tokens", "b.tokens"))).where(F.size("shared") >= min_shared)
    cut = lambda c: F.substring(c, 1, 240)
    out = pair.select(F.col("a.qid").alias("qid"), F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), F.slice("shared", 1, 6).alias("shared_terms"), cut("a.text").alias("text_a"), F.col("a.source_idx").alias("source_a"), cut("b.text").alias("text_b"), F.col("b.source_idx").alias("source_b"))
    return top_k(out, ["pos_a", "pos_b"], most)


def source_status(df: DataFrame, min_content_chars: int = 200) -> DataFrame:
    """df(fetched boolean, content): ok, empty (too short) or fetch_failed."""
    chars = F.length(F.coalesce("content", F.lit("")))
    return df.withColumn("status", F.when(~F.coalesce("fetched", F.lit(False)), "fetch_failed").when(chars < min_content_chars, "empty").otherwise("ok"))
