"""Column functions over text: words, sentences, sets, fingerprints, n-grams. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed (Unicode white space counts)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def cjk_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({fixed.CJK}+)"), 1)


def tokenize(c: Column, min_cjk: int = 2) -> Column:
    """Pairs of neighbouring CJK characters first, then lower-cased Latin words without stop words; repeats stay."""
    pairs = F.transform(cjk_runs(c), lambda r: F.when(F.length(r) <= min_cjk, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))))
    words = F.transform(F.regexp_extract_all(c, F.lit(f"({fixed.LATIN_WORD})"), 1), lambda w: F.regexp_replace(F.lower(w), r"^[._\-]+|[._\-]+$", ""))
    return F.coalesce(F.concat(F.flatten(pairs), F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(fixed.STOP_WORDS))), F.array().cast("array<string>"))


def content_tokens(c: Column) -> Column:
    """Tokens without stop words and numbers."""
    return F.filter(tokenize(c), lambda t: ~t.isin(fixed.STOP_WORDS) & ~t.rlike(r"^\d+$"))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokenize(c))


def sentences(c: Column) -> Column:
    parts = F.transform(F.split(c, fixed.SENTENCE_END), squeeze)
    return F.coalesce(F.filter(parts, lambda s: F.length(s) >= 8), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """The share of a's elements that b has."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.lit(1)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def token_bits(token: Column) -> tuple[Column, Column]:
    """The first eight bytes of a token's MD5 as two longs of 32 bits."""
    part = lambda at: F.conv(F.substring(F.md5(token), at, 8), 16, 10).cast("long")
    return part(1), part(9)


def title_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^一-鿿 a-zA-Z0-9]", "")


def strip_cjk(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), "[　-〿一-鿿＀-￯]+", " "))


def clean_markup(c: Column) -> Column:
    """Tags and surplus white space go, spaces between CJK characters too; entities are the caller's (html.unescape)."""
    flat = squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""))
    return F.regexp_replace(flat, f"(?<={fixed.CJK}) +(?={fixed.CJK})", "")


def cjk_ngrams(c: Column, sizes=(2, 3, 4, 5, 6)) -> Column:
    """Structs (term, left, right) of all runs' n-grams; left and right are null at a run's ends."""
    def of(r: Column, n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - n + 1, F.lit(1))), lambda i: F.struct(F.substr(r, i, F.lit(n)).alias("term"), F.when(i > 1, F.substr(r, i - 1, F.lit(1))).alias("left"), F.when(i + n <= F.length(r), F.substr(r, i + n, F.lit(1))).alias("right")))
        return F.when(F.length(r) >= n, grams)

    each = F.transform(cjk_runs(c), lambda r: F.flatten(F.filter(F.array(*[of(r, n) for n in sizes]), lambda x: x.isNotNull())))
    return F.flatten(each)


def paragraphs(c: Column) -> Column:
    parts = F.transform(F.split(c, r"\n\s*\n"), squeeze)
    return F.filter(parts, lambda p: (F.length(p) >= fixed.PARAGRAPH_CHARS) & p.rlike(r"(?U)[\w一-鿿]"))


def text_score(c: Column) -> Column:
    """How much a text looks like an article's."""
    n = F.length(c)
    marks = F.least(F.regexp_count(c, F.lit(fixed.SENTENCE_MARK)), F.lit(60)) * 0.9
    words = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")) / 25.0
    body = F.when(c.rlike(fixed.CJK), F.least(n / 120.0, F.lit(12.0))).otherwise(F.least(words, F.lit(12.0)))
    return F.when(n == 0, 0.0).otherwise(F.least(n, F.lit(1500)) / 100.0 + marks + body)


def class_weight(sig: Column) -> Column:
    """30 for a hint of an article in id and class, -40 for a hint of a page's frame; both may apply."""
    return F.when(sig.rlike(f"(?i){fixed.POSITIVE_HINT}"), 30.0).otherwise(0.0) - F.when(sig.rlike(f"(?i){fixed.NEGATIVE_HINT}"), 40.0).otherwise(0.0)


def headline_score(anchor: Column, in_heading: Column) -> Column:
    n = F.length(anchor)
    points = [(n >= 12, 4.0), (n >= 20, 3.0), (anchor.rlike(fixed.CJK) & (n >= 6), 3.0), (anchor.rlike(fixed.HEADLINE_MARKS), 1.5), (in_heading, 6.0)]
    return sum((F.when(test, p).otherwise(0.0) for test, p in points), F.lit(0.0))


def publication_date(c: Column) -> Column:
    """YYYY-MM-DD or YYYY of the first date in the text, else ''."""
    day = r"((?:19|20)\d{2})[-/年](\d{1,2})[-/月](\d{1,2})"
    part = lambda k: F.regexp_extract(c, day, k)
    full = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.coalesce(F.when(c.rlike(day), full).otherwise(F.regexp_extract(c, r"((?:19|20)\d{2})", 1)), F.lit(""))


def year_of(c: Column, now_year: int) -> Column:
    """The first year in the text if it is one from 1990 to next year."""
    year = F.regexp_extract(c, r"(19|20)\d{2}", 0).try_cast("int")
    return F.when(year.between(1990, now_year + 1), year)


def freshness(published: Column, now_year: int, content: Column | None = None, chars: int | None = fixed.MATCH_CHARS) -> Column:
    """content: also look for the latest year in the text's head (or all of it, if chars is None), if there is no date."""
    year = year_of(published, now_year)
    if content is not None:
        found = F.transform(F.regexp_extract_all(content if chars is None else F.substring(content, 1, chars), F.lit(r"((?:19|20)\d{2})"), 1), lambda y: y.cast("int"))
        year = F.coalesce(year, F.array_max(F.filter(found, lambda y: y.between(1990, now_year + 1))))
    return F.when(year.isNull(), fixed.FRESH_UNKNOWN).otherwise(F.greatest(F.lit(fixed.FRESH_LEAST), 1.0 - F.greatest(F.lit(0), now_year - year) * fixed.FRESH_STEP))


def short_time(seconds: Column) -> Column:
    """12.3s or 2m5s."""
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).otherwise(F.format_string("%dm%ds", F.floor(seconds / 60).cast("long"), F.floor(F.pmod(seconds, F.lit(60.0))).cast("long")))


def opposes(c: Column) -> Column:
    return c.rlike(f"(?i){fixed.OPPOSITION}")


def sniff_charset(head: Column) -> Column:
    """The character set that a page names in its first bytes, lower-cased."""
    text = F.decode(F.substring(head, 1, 4096), "ISO-8859-1")
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)<meta[^>]+charset\s*=\s*[\"']?\s*([a-z0-9_\-]+)", 1), F.lit("")), F.lit("")))
