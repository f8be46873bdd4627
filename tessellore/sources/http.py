"""Fetched pages as a DataFrame: a polite reader over addresses, with a cache in front.

Every task fetches its rows one after another with a pause; ``tasks`` bounds how many do so at once,
which together bounds the rate over the whole cluster.
"""

from __future__ import annotations

import hashlib
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Fixed values.
RETRY_STATUS = (429, 500, 502, 503, 504)
ATTEMPTS, MOST_PAUSE, DELAY = 4, 30.0, 0.5
ERROR_CHARS = 300

FETCHED = "url string, html string, http_status int, cache_hit boolean, body_hash string, error string"


def http_get(url: str) -> tuple[int, str]:
    """Status and text of one request; statuses other than 200 come back instead of raising."""
    try:
        with urllib.request.urlopen(url, timeout=60) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, ""


def fetch_one(url: str, get: Callable[[str], tuple[int, str]], pause: Callable[[float], None], attempts: int = ATTEMPTS) -> tuple[int | None, str, str | None]:
    """(status, html, error): server errors are retried after 2, 4, 8 seconds and a part, other statuses are final.

    A network that fails each time is no exception here but a row with its error, so one address cannot end a crawl.
    """
    last: tuple[int | None, str, str | None] = (None, "", None)
    for attempt in range(attempts):
        try:
            status, html = get(url)
        except OSError as error:
            last = (None, "", f"{type(error).__name__}: {error}"[:ERROR_CHARS])
        else:
            if status == 200:
                return status, html, None
            if status not in RETRY_STATUS:
                return status, "", f"http {status}"
            last = (status, "", f"http {status} after {attempt + 1} attempts")
        if attempt + 1 < attempts:
            pause(min(2.0 ** (attempt + 1), MOST_PAUSE) + random.random())
    return last


def _fetch(get: Callable, delay: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, html in zip(batch["url"], batch["html"]):
                if isinstance(html, str):
                    rows.append((url, html, 200, True, hashlib.sha256(html.encode()).hexdigest(), None))
                    continue
                time.sleep(delay)
                status, found, error = fetch_one(url, get, time.sleep)
                rows.append((url, found, status, False, hashlib.sha256(found.encode()).hexdigest() if found else None, error))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FETCHED.split(", ")])
            out["http_status"] = out["http_status"].astype("Int32")
            yield out

    return run


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str]] = http_get, delay: float = DELAY, tasks: int = 1) -> DataFrame:
    """Pages of addresses (url, html from the cache or null)."""
    return urls.select("url", "html").repartition(tasks).mapInPandas(_fetch(get, delay), FETCHED)
