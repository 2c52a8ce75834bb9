"""HTML documents as flat node tables, selectors over them, article extraction and result pages. Pure Python, used from
Arrow batches: udf-like wrappers are at the end.

A page is a list of nodes in document order. Node k's subtree is nodes[k:end[k]], and its text is the pieces [text_from[k],
text_to[k]); so text, descendants and removal are slices, and no tree is walked. Parsing never fails: broken markup closes
what it can. Contents of scripts, styles and the like are not kept.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from . import fixed

_VOID, _SELF, _SKIP, _BLOCK = set(fixed.VOID_TAGS), set(fixed.SELF_CLOSING_TAGS), set(fixed.SKIPPED_TAGS), set(fixed.BLOCK_TAGS)
_CJK = re.compile(fixed.CJK)


def squeeze(s: str) -> str:
    return " ".join(s.split())


class Page(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.end = ["#document"], [{}], [-1], [0]
        self.text_from, self.text_to, self.pieces = [0], [0], []
        self.flow: list[tuple[str, int]] = []  # open, text and close in order
        self.flow_from, self.flow_to = [0], [0]
        self.open, self.skipping = [0], 0
        self.gone: set[int] = set()
        self.cuts: list[int] = []  # those of gone in document order
        try:
            self.feed(source or "")
            self.close()
        except Exception:  # noqa: BLE001  what was read until here stays
            pass
        self._shut(0)

    # building

    def handle_starttag(self, tag, attrs):
        if self.skipping:
            self.skipping += tag in _SKIP
            return
        top = self.tag[self.open[-1]]
        if tag in _SELF and (top == tag or {tag, top} <= {"td", "th"}):
            self._shut(len(self.open) - 1)
        k = len(self.tag)
        self.tag.append(tag)
        self.attrs.append({n.lower(): v or "" for n, v in attrs})
        self.parent.append(self.open[-1])
        self.end.append(k + 1)
        self.text_from.append(len(self.pieces))
        self.text_to.append(len(self.pieces))
        self.flow_from.append(len(self.flow))
        self.flow_to.append(len(self.flow) + 1)
        self.flow.append(("open", k))
        if tag in _VOID:
            self.flow.append(("close", k))
        else:
            self.open.append(k)
            self.skipping = int(tag in _SKIP)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skipping:
            if tag in _SKIP:
                self.skipping -= 1
                if self.skipping == 0:
                    self._shut(len(self.open) - 1)
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[at]] == tag:
                self._shut(at)
                return

    def handle_data(self, data):
        if not self.skipping and data.strip():
            self.flow.append(("text", len(self.pieces)))
            self.pieces.append(data)

    def _shut(self, at: int) -> None:
        """Closes all open nodes from this depth on."""
        while len(self.open) > at:
            k = self.open.pop()
            self.end[k], self.text_to[k], self.flow_to[k] = len(self.tag), len(self.pieces), len(self.flow)
            self.flow.append(("close", k))

    # reading

    def attr(self, k: int, name: str) -> str:
        return self.attrs[k].get(name, "")

    def sig(self, k: int) -> str:
        return f"{self.attr(k, 'id')} {self.attr(k, 'class')}"

    def inside(self, k: int):
        """Descendants that are still there, in document order."""
        n, stop = k + 1, self.end[k]
        while n < stop:
            if n in self.gone:
                n = self.end[n]
            else:
                yield n
                n += 1

    def children(self, k: int):
        n, stop = k + 1, self.end[k]
        while n < stop:
            if n not in self.gone:
                yield n
            n = self.end[n]

    def text(self, k: int) -> str:
        if len(self.cuts) != len(self.gone):
            self.cuts = sorted(self.gone)
        out, at = [], self.text_from[k]
        for n in self.cuts[bisect_right(self.cuts, k) : bisect_left(self.cuts, self.end[k])]:
            out += self.pieces[at : self.text_from[n]]
            at = max(at, self.text_to[n])
        return squeeze(" ".join(out + self.pieces[at : self.text_to[k]]))

    def above(self, k: int):
        while (k := self.parent[k]) >= 0:
            yield k

    def depth(self, k: int) -> int:
        return sum(1 for _ in self.above(k))

    def named(self, tag: str, root: int = 0) -> list[int]:
        """The root's descendants with this tag, in document order."""
        return [n for n in self.inside(root) if self.tag[n] == tag]

    def links(self, k: int) -> float:
        """The share of a node's text that is in links; 1 without text."""
        n = len(self.text(k))
        return 1.0 if n == 0 else min(1.0, sum(len(self.text(a)) for a in self.inside(k) if self.tag[a] == "a") / n)

    def layout(self, k: int) -> str:
        """Text with paragraphs: blocks apart, list items on lines of their own."""
        out: list[str] = []
        skip_to, end_at = -1, self.flow_to[k]
        gap = lambda: out.append("\n\n") if out and not out[-1].endswith("\n\n") else None
        for what, n in self.flow[self.flow_from[k] : end_at + 1]:
            if skip_to >= 0:
                if what == "close" and n == skip_to:
                    skip_to = -1
                continue
            if what == "text":
                out.append(self.pieces[n])
            elif what == "open" and n in self.gone:
                skip_to = n
            elif self.tag[n] == "br":
                out += ["\n"] * (what == "open")
            elif what == "open" and self.tag[n] == "li":
                out.append("\n- ")
            elif self.tag[n] in _BLOCK:
                gap()
        s = re.sub(r"[ \t 　]+", " ", "".join(out))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", s)).strip()


# ---- selectors --------------------------------------------------------------------------------------------------------

_PART = re.compile(r"#(?P<id>[^.#\[\]\s>+,]+)|\.(?P<cls>[^.#\[\]\s>+,]+)|\[\s*(?P<name>[\w\-:]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\]\s]*))?\s*\]")
_TESTS = {
    "=": lambda have, want: have == want, "*=": lambda have, want: want in have, "^=": lambda have, want: have.startswith(want), "$=": lambda have, want: have.endswith(want),
    "~=": lambda have, want: want in have.split(), "|=": lambda have, want: have == want or have.startswith(want + "-"),
}
_compiled: dict[str, list] = {}


def _simple(token: str):
    tag = re.match(r"[\w\-*]*", token)[0].lower()
    parts = [m.groupdict() for m in _PART.finditer(token)]
    ids = {p["id"] for p in parts if p["id"]}
    classes = {p["cls"] for p in parts if p["cls"]}
    tests = [(p["name"].lower(), p["op"], (p["val"] or "").strip("\"'")) for p in parts if p["name"]]

    def fits(page: Page, k: int) -> bool:
        a = page.attrs[k]
        return (
            (tag in ("", "*") or page.tag[k] == tag) and (not ids or a.get("id") in ids) and classes <= set(a.get("class", "").split())
            and all(n in a and (not op or _TESTS[op](a[n], v)) for n, op, v in tests)
        )

    return fits


def compiled(selector: str) -> list[list[tuple[bool, object]]]:
    """For each alternative its steps: (child only, test)."""
    if selector not in _compiled:
        groups = []
        for one in selector.split(","):
            plain = re.sub(r":{1,2}[\w\-]+(\([^)]*\))?", "", one).strip()
            steps, child = [], False
            for token in re.findall(r">|[^\s>]+", plain) or ["*"]:
                if token == ">":
                    child = True
                else:
                    steps.append((child, _simple(token)))
                    child = False
            if one.strip():
                groups.append(steps)
        _compiled[selector] = groups
    return _compiled[selector]


def _found(page: Page, root: int, steps) -> list[int]:
    now = [root]
    for child, fits in steps:
        now = list(dict.fromkeys(n for k in now for n in (page.children(k) if child else page.inside(k)) if fits(page, n)))
    return now


def select(page: Page, selector: str, root: int = 0) -> list[int]:
    """Nodes of all alternatives, one alternative after the other."""
    return list(dict.fromkeys(n for steps in compiled(selector) for n in _found(page, root, steps)))


def first(page: Page, selectors, root: int = 0) -> int | None:
    for s in [selectors] if isinstance(selectors, str) else selectors:
        if found := select(page, s, root):
            return found[0]
    return None


# ---- articles ---------------------------------------------------------------------------------------------------------


@dataclass
class Article:
    url: str = ""
    title: str = ""
    text: str = ""
    paragraphs: list[str] = field(default_factory=list)
    author: str = ""
    site: str = ""
    published: str = ""
    lang: str = ""
    word_count: int = 0
    char_count: int = 0
    extractor: str = "empty"


def metadata(page: Page, source: str, this_year: int) -> dict[str, str]:
    meta: dict[str, str] = {}
    for k in select(page, "meta"):
        name = (page.attr(k, "property") or page.attr(k, "name") or page.attr(k, "itemprop")).strip().lower()
        if name:
            meta.setdefault(name, page.attr(k, "content").strip())
    shown = lambda *s: next((t for x in s if (k := first(page, x)) is not None and (t := page.text(k))), "")
    pick = lambda *names: next((meta[n] for n in names if meta.get(n)), "")
    k, time, root = first(page, "meta[name=application-name]"), first(page, "time[datetime]"), first(page, "html")
    when = pick(*fixed.DATE_KEYS) or (page.attr(time, "datetime") if time is not None else "")
    day = re.search(r"((?:19|20)\d{2})[-/年](\d{1,2})[-/月](\d{1,2})", when)
    year = re.search(r"(?:19|20)\d{2}", when)
    when = f"{day[1]}-{int(day[2]):02d}-{int(day[3]):02d}" if day else year[0] if year else ""
    if when and not 2005 <= int(when[:4]) <= this_year + 1:
        when = ""
    title = pick("og:title", "twitter:title") or shown("h1", "title")
    lang = (page.attr(root, "lang") or page.attr(root, "xml:lang") if root is not None else "") or meta.get("og:locale", "")
    return {
        "title": squeeze(title)[:300],
        "site": squeeze(meta.get("og:site_name") or (page.attr(k, "content") if k is not None else ""))[:80],
        "author": squeeze(pick("author", "article:author", "og:article:author") or shown(".author", ".byline", "[rel=author]", ".article-author"))[:80],
        "published": when,
        "lang": (lang or ("zh" if _CJK.search(title + source[:2000]) else "en"))[:12],
    }


_GOOD, _BAD = re.compile(fixed.POSITIVE_HINT, re.I), re.compile(fixed.NEGATIVE_HINT, re.I)
_MARK = re.compile(fixed.SENTENCE_MARK)


def text_score(s: str) -> float:
    if not s:
        return 0.0
    body = len(s) / 120 if _CJK.search(s) else len(s.split()) / 25
    return min(len(s), 1500) / 100 + 0.9 * min(len(_MARK.findall(s)), 60) + min(body, 12.0)


def strip_frame(page: Page) -> None:
    """Navigation, footers and what looks like them go."""
    doomed = []
    for k in page.inside(0):
        if page.tag[k] in ("nav", "footer", "aside", "form") or (_BAD.search(page.sig(k)) and (page.links(k) > 0.35 or len(page.text(k)) < 400)):
            doomed.append(k)
    page.gone.update(doomed)


def main_node(page: Page) -> tuple[int | None, float]:
    """The node that looks most like the article. A node passes a share of its points to its parent."""
    points: dict[int, float] = {}
    for k in [0, *page.inside(0)]:
        if page.tag[k] not in ("p", "article", "section", "main", "div", "td", "blockquote", "pre"):
            continue
        s = page.text(k)
        links = page.links(k)
        if len(s) < 40 or (links > 0.6 and len(s) < 800):
            continue
        own = text_score(s) * (1 - links) + 30.0 * bool(_GOOD.search(page.sig(k))) - 40.0 * bool(_BAD.search(page.sig(k)))
        own += 1.2 * min(20, sum(page.tag[c] == "p" for c in page.children(k)))
        points[k] = own
        up = page.parent[k]
        if up > 0 and page.tag[up] not in ("html", "body"):
            points[up] = points.get(up, 0.0) + 0.35 * own
    return (max(points, key=points.get), max(points.values())) if points else (None, 0.0)


def paragraphs(s: str) -> list[str]:
    return [p for raw in re.split(r"\n\s*\n", s) if len(p := squeeze(raw)) >= fixed.PARAGRAPH_CHARS and re.search(r"\w", p)]


def article(source: str | None, url: str = "", this_year: int = 2026) -> Article:
    if not source or len(source) < 100:
        return Article(url=url)
    page = Page(source)
    about = metadata(page, source, this_year)
    strip_frame(page)
    out, s = Article(url=url, **about), ""
    if (k := first(page, ["article", "main"])) is not None and len(page.text(k)) >= 200:
        s, out.extractor = page.layout(k), "semantic"
    if len(s) < 200:
        k, points = main_node(page)
        if k is not None and points > 0:
            s, out.extractor = page.layout(k), "readability-lite"
    if len(s) < 200:
        k = first(page, "body")
        s, out.extractor = page.layout(0 if k is None else k), "body-fallback"
    if out.title and s.lstrip().startswith(out.title):
        s = s.lstrip()[len(out.title) :]
    out.text = s.strip()
    out.paragraphs, out.char_count = paragraphs(out.text), len(out.text)
    out.word_count = out.char_count if _CJK.search(out.text) else len(out.text.split())
    return out


def snippet(s: str, terms: list[str], width: int = 260) -> str:
    """The window of the text with most of the terms; it starts a third before one of them."""
    if not s or not terms:
        return squeeze((s or "")[:width])
    low, wanted = s.lower(), [t.lower() for t in terms]
    best, at = 0, 0
    for t in (t.strip() for t in wanted[:12]):
        if len(t) < 2:
            continue
        for m in re.finditer(re.escape(t), low):
            start = max(0, m.start() - width // 3)
            n = sum(w in low[start : start + width] for w in wanted)
            if n > best:
                best, at = n, start
        if best >= 3:
            break
    return squeeze(("…" if at else "") + s[at : at + width] + ("…" if at + width < len(s) else ""))


# ---- result pages -----------------------------------------------------------------------------------------------------

_RESULT, _FRAME = re.compile(fixed.RESULT_HINT, re.I), re.compile(fixed.FRAME_HINT, re.I)
_CONTROL, _CONTROL_PART = re.compile(fixed.CONTROL_ANCHOR, re.I), re.compile(fixed.CONTROL_PART, re.I)


def holds_content(url: str) -> bool:
    low = (url or "").lower()
    return low.startswith(("http://", "https://")) and not any(x in low for x in fixed.NO_CONTENT)


def unwrap(url: str) -> str:
    import base64
    from urllib.parse import unquote

    m = re.search(r"[?&]u=a1([^&]+)", url or "")
    if not m or "bing.com/ck/a" not in url:
        return url
    code = unquote(m[1])
    try:
        return base64.urlsafe_b64decode(code + "=" * (-len(code) % 4)).decode("utf-8", "replace")
    except ValueError:
        return url


def domain(url: str) -> str:
    m = re.match(r"[a-zA-Z][\w+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    host = m[1].lower() if m else ""
    for p in ("www.", "m.", "mobile.", "wap."):
        host = host.removeprefix(p)
    return host


def clean(s: str) -> str:
    return re.sub(f"(?<={fixed.CJK})\\s+(?={fixed.CJK})", "", squeeze(re.sub(r"<[^>]+>", "", entities.unescape(s or ""))))


def hit(title: str, url: str, snip: str, position: int) -> dict:
    return {"title": clean(title)[:300], "url": unwrap(url.strip())[:900], "snippet": clean(snip)[:600], "position": position}


def _container(page: Page, a: int) -> int:
    """The nearest of four ancestors that looks like a result, else the first of fitting size."""
    fitting = None
    for _, k in zip(range(4), page.above(a), strict=False):
        if page.tag[k] in ("body", "html", "#document"):
            break
        n = len(page.text(k))
        if _RESULT.search(page.sig(k)) and 60 < n < 4000:
            return k
        if fitting is None and 80 < n < 3000:
            fitting = k
    return fitting if fitting is not None else page.parent[a]


def results(source: str, own_sites: tuple[str, ...] = (), limit: int = 10) -> list[dict]:
    """Results of any result page: links out with a headline, in a container with a real snippet."""
    page, found, seen = Page(source), [], set()
    for a in page.inside(0):
        if page.tag[a] != "a":
            continue
        url, anchor = unwrap(page.attr(a, "href")), page.text(a)
        site = domain(url)
        if not holds_content(url) or any(site == s or site.endswith("." + s) for s in own_sites) or len(anchor) < 6 or _CONTROL.match(anchor) or _CONTROL_PART.search(anchor) or url.split("#")[0] in seen:
            continue
        box = _container(page, a)
        is_result = bool(_RESULT.search(page.sig(box)))
        if _FRAME.search(page.sig(box)) and not is_result:
            continue
        whole = page.text(box)
        snip = re.sub(fixed.READ_MORE, "", squeeze(whole.replace(anchor, " ", 1)))
        if len(snip) < 25 or (len(anchor) / max(1, len(whole)) > 0.75 and len(snip) < 60):
            continue
        points = 4.0 * (len(anchor) >= 12) + 3.0 * (len(anchor) >= 20) + 3.0 * bool(_CJK.search(anchor) and len(anchor) >= 6) + 1.5 * bool(re.search(fixed.HEADLINE_MARKS, anchor))
        points += 6.0 * any(page.tag[k] in ("h1", "h2", "h3", "h4") for k in page.above(a)) + min(len(snip), 300) / 40 + 6.0 * is_result - 3.0 * bool(re.fullmatch(r"[a-z]+://[^/]*/*(?:[?#].*)?", url, re.I))
        if points >= 6:
            seen.add(url.split("#")[0])
            found.append((points, anchor, url, snip))
    found.sort(key=lambda x: -x[0])
    return [hit(t, u, s, n) for n, (_, t, u, s) in enumerate(found[:limit], 1)]


def bing_results(source: str, limit: int = 10) -> list[dict]:
    page, out = Page(source), []
    for n, li in enumerate(select(page, "li.b_algo")[:limit], 1):
        a = first(page, ["h2 a", "a[href^=http]"], li)
        if a is None or not holds_content(url := unwrap(page.attr(a, "href"))):
            continue
        title = page.text(a)
        k = first(page, [".b_caption p", ".b_lineclamp2", "p"], li)
        out.append(hit(title, url, (page.text(k) if k is not None else "") or page.text(li).replace(title, " ", 1), n))
    return out or results(source, fixed.OWN_SITES["bing_cn"], limit)


def baidu_results(source: str, limit: int = 10) -> list[dict]:
    page, out, seen = Page(source), [], set()
    boxes = next((b for s in ("#content_left .result", "#content_left .c-container", ".result.c-container", "#content_left > div[class*=result]") if (b := select(page, s))), [])
    for box in boxes:
        a = first(page, ["h3 a", "a[href]"], box)
        if a is None or len(out) >= limit:
            continue
        url = unwrap(page.attr(box, "mu") or page.attr(box, "data-url") or page.attr(a, "mu") or page.attr(a, "data-landurl") or page.attr(a, "href"))
        title = page.text(a)
        if (not holds_content(url) and not url.startswith("http")) or "baidu.com/link?" in url or len(title) < 4 or url.split("#")[0] in seen:
            continue
        seen.add(url.split("#")[0])
        k = first(page, ["[class*=content-right]", ".c-abstract", "[class*=abstract]", "[class*=c-span-last]", ".c-color-text"], box)
        out.append(hit(title, url, (page.text(k) if k is not None else "") or page.text(box).replace(title, " ", 1), len(out) + 1))
    return out or results(source, fixed.OWN_SITES["baidu"], limit)


# ---- over columns -----------------------------------------------------------------------------------------------------

ARTICLE = "url string, title string, text string, paragraphs array<string>, author string, site string, published string, lang string, word_count int, char_count int, extractor string"
HIT = "array<struct<title string, url string, snippet string, position int>>"


def articles(this_year: int):
    """Column function (html, url) to an article struct."""

    @F.pandas_udf(ARTICLE)
    def run(source: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vars(article(s, u, this_year)) for s, u in zip(source, url, strict=True)], columns=[c.split()[0] for c in ARTICLE.split(", ")])

    return run


def selected(selector: str):
    """Column function html to the nodes that a selector finds: tag, attributes, text."""

    @F.pandas_udf("array<struct<tag string, attrs map<string, string>, text string>>")
    def run(source: pd.Series) -> pd.Series:
        return pd.Series([[{"tag": p.tag[k], "attrs": p.attrs[k], "text": p.text(k)} for k in select(p, selector)] for p in map(Page, source)])

    return run


def nodes():
    """Column function html to the page's node table in document order; node 0 is the document, whose parent is -1."""

    @F.pandas_udf("array<struct<node int, parent int, depth int, tag string, attrs map<string, string>, text string>>")
    def run(source: pd.Series) -> pd.Series:
        tables = []
        for p in map(Page, source):
            depth = [0]
            for up in p.parent[1:]:
                depth.append(depth[up] + 1)
            tables.append([{"node": k, "parent": p.parent[k], "depth": depth[k], "tag": p.tag[k], "attrs": p.attrs[k], "text": p.text(k)} for k in range(len(p.tag))])
        return pd.Series(tables)

    return run


def result_hits(engine_id: str, limit: int = 10):
    """Column function html to the hits of an engine's result page."""
    parse = {"bing_cn": bing_results, "bing_intl": bing_results, "baidu": baidu_results}.get(engine_id, lambda s, n: results(s, fixed.OWN_SITES.get(engine_id, ()), n))

    @F.pandas_udf(HIT.replace("array<struct<title string, url string, snippet string, position int>>", "array<struct<title:string,url:string,snippet:string,position:int>>"))
    def run(source: pd.Series) -> pd.Series:
        return pd.Series([parse(s, limit) for s in source])

    return run
