"""HTTP sources as a Python data source: one partition for each domain and window or page, with retries in the reader."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds to wait after too many requests, after other trouble, and tries in all.
BUSY_S, TROUBLE_S, TRIES = 900, 30, 5


def get(url: str, timeout: float = 30) -> tuple[int, str]:
    """Status and body of a GET; connection trouble counts as 599."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as reply:
            return reply.status, reply.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""
    except (urllib.error.URLError, TimeoutError, OSError):
        return 599, ""


def fetch_with_retry(url: str, fetch=get, wait=time.sleep, tries: int = TRIES) -> str | None:
    """The body of a reply that is JSON; None if it can't be had.

    200 ends the search, also with a body that is no JSON; 429 waits long, 500 and more and connection trouble wait a
    little; any other status gives up.
    """
    for _ in range(tries):
        status, body = fetch(url)
        if status == 200:
            try:
                json.loads(body)
            except ValueError:
                wait(TROUBLE_S)
                continue
            return body
        if status == 429:
            wait(BUSY_S)
        elif status >= 500:
            wait(TROUBLE_S)
        else:
            return None
    return None


def window_url(base: str, domain: str, start: str, end: str, most: int = 250) -> str:
    query = {"query": f"domain:{domain}", "mode": "artlist", "maxrecords": most, "startdatetime": start, "enddatetime": end, "format": "json"}
    return f"{base}?{urllib.parse.urlencode(query)}"


def page_url(base: str, query: str, begin: str, end: str, page: int, key: str = "") -> str:
    """One page of a search; fl asks the API for the needed fields only."""
    wanted = {"q": query, "begin_date": begin, "end_date": end, "page": page, "fl": "headline,pub_date,web_url,_id"}
    return f"{base}?{urllib.parse.urlencode(wanted | ({'api-key': key} if key else {}))}"


def whole_window(url_of, start: int, end: int, read, most: int = 250, least: int = 60):
    """The records of a window (seconds from start to end, both included) of an API that returns `most` at once.

    url_of(start, end) names a request and read(url) gives its records, or None if it failed. A full reply may have lost
    some, so its window is cut in two, down to `least` seconds. ValueError if a request fails, or if one so short is full:
    nothing is lost without a word.
    """
    found = read(url_of(start, end))
    if found is None:
        raise ValueError(f"the window {start} to {end} could not be read")
    if len(found) < most:
        return list(found)
    if end - start < least:
        raise ValueError(f"over {most} records between {start} and {end}")
    middle = (start + end) // 2
    return whole_window(url_of, start, middle, read, most, least) + whole_window(url_of, middle + 1, end, read, most, least)


def all_pages(url_of, read, most: int = 5) -> list:
    """The records of the pages 0, 1, ... of a search, up to `most` pages or the first that is empty or fails."""
    found: list = []
    for page in range(most):
        records = read(url_of(page))
        if not records:
            break
        found += records
    return found


@dataclass
class _Url(InputPartition):
    url: str


class UrlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options["urls"])
        self.tries = int(options.get("tries", TRIES))
        self.pause = float(options.get("pause", 1))

    def partitions(self):
        return [_Url(u) for u in self.urls] or [_Url("")]

    def read(self, partition):
        if partition.url:
            body = fetch_with_retry(partition.url, wait=lambda s: time.sleep(s * self.pause), tries=self.tries)
            yield partition.url, body is not None, body


class UrlSource(DataSource):
    """spark.read.format("urls").option("urls", json).load(): a row (url, ok, body) for each URL."""

    @classmethod
    def name(cls):
        return "urls"

    def schema(self):
        return "url string, ok boolean, body string"

    def reader(self, schema):
        return UrlReader(dict(self.options))


def fetched(spark: SparkSession, urls: list[str], **options: str):
    spark.dataSource.register(UrlSource)
    return spark.read.format("urls").options(urls=json.dumps(urls), **options).load()
