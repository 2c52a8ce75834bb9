"""Fetching: requests as rows, responses as rows. A transport (url, headers, timeout) -> (status, headers, bytes) is given, so
everything runs without a network; urllib is the default one.

Rows of one host go to one task, in order, which keeps the interval between requests; the cache is a table that is joined and
appended to. A request row says itself what its timeout is and whether robots.txt counts.
"""

from __future__ import annotations

import gzip
import random
import re
import time
import urllib.error
import urllib.request
import urllib.robotparser
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import fixed, urls

RESPONSE = "url string, status int, content_type string, body string, error string, ms double, attempts int"
BINARY = ("image/", "audio/", "video/", "application/pdf", "application/zip", "application/octet-stream", "font/", "application/x-")
MOST_BYTES = 3_000_000


def default_transport(url: str, headers: dict, timeout: float) -> tuple[int, dict, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:  # noqa: S310  http(s) only, see fetch_one
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read(MOST_BYTES)
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read(MOST_BYTES)


def decompress(data: bytes, encoding: str) -> bytes:
    """gzip and deflate (with or without header); anything else, or what fails, stays."""
    try:
        if "gzip" in encoding:
            return gzip.decompress(data)
        if "deflate" in encoding:
            try:
                return zlib.decompress(data)
            except zlib.error:
                return zlib.decompress(data, -zlib.MAX_WBITS)
    except (OSError, EOFError, zlib.error):
        pass
    return data


def decode(data: bytes, content_type: str = "") -> str:
    """By the header's character set, the page's own, then the usual ones; the first that fits without error."""
    head = re.search(r"charset\s*=\s*[\"']?([\w\-]+)", content_type or "", re.I)
    meta = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([\w\-]+)", data[:4096], re.I)
    for name in dict.fromkeys([head[1] if head else None, meta[1].decode() if meta else None, *fixed.CHARSETS]):
        try:
            if name:
                return data.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("utf-8", "replace")


def fetch_one(url: str, timeout: float, transport: Callable, retries: int = fixed.DEFAULTS["retries"], agent: str = "gleaner", sleep=time.sleep, headers: dict | None = None) -> dict:
    out = {"url": url, "status": 0, "content_type": "", "body": "", "error": "", "ms": 0.0, "attempts": 0}
    if not url.lower().startswith(("http://", "https://")):
        return out | {"error": "scheme"}
    began, sent = time.monotonic(), {"User-Agent": agent, "Accept-Encoding": "gzip, deflate"} | (headers or {})
    for attempt in range(retries + 1):
        out["attempts"] = attempt + 1
        try:
            status, got, data = transport(url, sent, timeout)
            kind = got.get("content-type", "")
            out |= {"status": status, "content_type": kind, "error": "" if 200 <= status < 400 else f"http {status}"}
            if any(b in kind for b in BINARY):
                out |= {"error": "binary"}
            else:
                out["body"] = decode(decompress(data, got.get("content-encoding", "")), kind)
        except Exception as e:  # noqa: BLE001  one bad address must not end the batch
            out |= {"status": 0, "error": str(e)[:200] or type(e).__name__}
        if out["status"] != 429 and out["status"] < 500 and out["status"]:
            break
        if attempt < retries:
            sleep(1.5**attempt + random.random() * 0.6)  # noqa: S311
    return out | {"ms": (time.monotonic() - began) * 1000}


def robots_allow(url: str, transport: Callable, known: dict, agent: str = "gleaner", timeout: float = 5.0) -> bool:
    """By the site's robots.txt; a site without a readable one allows everything."""
    site = "{0.scheme}://{0.netloc}".format(urlsplit(url))
    if site not in known:
        rules = urllib.robotparser.RobotFileParser()
        try:
            status, _, data = transport(f"{site}/robots.txt", {"User-Agent": agent}, timeout)
            rules.parse(data.decode("utf-8", "replace").splitlines() if status == 200 else [])
        except Exception:  # noqa: BLE001
            rules.parse([])
        known[site] = rules
    return known[site].can_fetch(agent, url)


def fetch(requests: DataFrame, transport: Callable = default_transport, min_interval: float = fixed.DEFAULTS["min_interval"], partitions: int | None = None) -> DataFrame:
    """requests(url, timeout double, check_robots boolean, and headers map<string,string> if they have it) to RESPONSE. Each address is fetched once."""
    if "headers" not in requests.columns:
        requests = requests.withColumn("headers", F.create_map().cast("map<string,string>"))
    spread = requests.dropDuplicates(["url"]).withColumn("host", urls.domain(F.col("url")))
    spread = (spread.repartition(partitions, "host") if partitions else spread.repartition("host")).sortWithinPartitions("host", "url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        last: dict[str, float] = {}
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                if r.check_robots and not robots_allow(r.url, transport, known):
                    rows.append({"url": r.url, "status": 0, "content_type": "", "body": "", "error": "robots", "ms": 0.0, "attempts": 0})
                    continue
                wait = min_interval - (time.monotonic() - last.get(r.host, -1e9))
                if wait > 0:
                    time.sleep(wait)
                rows.append(fetch_one(r.url, r.timeout, transport, headers=dict(r.headers) if r.headers is not None else None))
                last[r.host] = time.monotonic()
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESPONSE.split(", ")])

    return spread.select("url", "timeout", "check_robots", "headers", "host").mapInPandas(run, RESPONSE)


def fetch_json(requests: DataFrame, transport: Callable = default_transport, **options) -> DataFrame:
    """fetch() of addresses that answer in JSON: RESPONSE and value, a variant; null where the answer is an error or no JSON."""
    asks = F.create_map(F.lit("Accept"), F.lit("application/json, text/plain, */*"))
    if "headers" in requests.columns:  # the request's own win
        own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
        asks = F.map_concat(F.map_filter(asks, lambda k, _: ~F.map_contains_key(own, k)), own)
    got = fetch(requests.withColumn("headers", asks), transport, **options)
    return got.withColumn("value", F.when(F.col("error") == "", F.try_parse_json("body")))


def cached(requests: DataFrame, cache: DataFrame, now: float, ttl: float = fixed.DEFAULTS["cache_ttl"]) -> tuple[DataFrame, DataFrame]:
    """Requests that the cache(url, ts, body) answers, with the newest body, and those that must be fetched."""
    live = cache.where(F.col("ts") >= now - ttl).groupBy("url").agg(F.max_by("body", "ts").alias("body"))
    return requests.join(live, "url"), requests.join(live.select("url"), "url", "left_anti")


class Addresses(DataSource):
    """spark.read.format("gleaner_urls"): option urls (one a line) to responses, a partition for each host."""

    @classmethod
    def name(cls) -> str:
        return "gleaner_urls"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema) -> DataSourceReader:
        return _Reader([u for u in self.options.get("urls", "").split("\n") if u], float(self.options.get("timeout", fixed.DEFAULTS["timeout"])))


class _Reader(DataSourceReader):
    def __init__(self, found: list[str], timeout: float):
        self.found, self.timeout = found, timeout

    def partitions(self):
        hosts: dict[str, list[str]] = {}
        for u in dict.fromkeys(self.found):
            hosts.setdefault(urlsplit(u).netloc, []).append(u)
        return [InputPartition(v) for v in hosts.values()]

    def read(self, partition):
        for u in partition.value:
            yield tuple(fetch_one(u, self.timeout, default_transport, retries=0).values())
