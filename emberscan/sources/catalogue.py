"""Remote catalogue connector: search in week chunks, resolve ids, download with retries.

Runs on the driver; the service's address is a parameter, nothing is built in.
"""

from __future__ import annotations

import datetime as dt
import os
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

# Pauses, tries and sizes.
CHUNK_DAYS, ID_BATCH = 7, 100
SEARCH_PAUSE, DOWNLOAD_PAUSE, TRIES, FIRST_WAIT = 1.0, 2.0, 3, 5.0
SEARCH_TIMEOUT, DOWNLOAD_TIMEOUT = 30, 300


def chunks(start: dt.date, end: dt.date, days: int = CHUNK_DAYS) -> Iterator[tuple[dt.date, dt.date]]:
    """Inclusive date ranges of ``days`` days that cover start..end."""
    at = start
    while at <= end:
        last = min(at + dt.timedelta(days=days - 1), end)
        yield at, last
        at = last + dt.timedelta(days=1)


def retried(call: Callable, tries: int = TRIES, wait: float = FIRST_WAIT, sleep: Callable = time.sleep):
    """``call()``, again after a growing pause on any URL error; the last error is raised."""
    for k in range(tries):
        try:
            return call()
        except urllib.error.URLError:
            if k == tries - 1:
                raise
            sleep(wait * 2**k)


def token(variable: str, env_file: str = ".env") -> str:
    """Access token from the environment, else from an env file; ValueError if there is none."""
    found = os.environ.get(variable, "")
    if not found and os.path.exists(env_file):
        with open(env_file) as f:
            pairs = (line.strip().partition("=") for line in f if "=" in line and not line.lstrip().startswith("#"))
            found = next((v.strip().strip("'\"") for k, _, v in pairs if k.strip() == variable), "")
    if not found or found.lower().startswith("your"):
        raise ValueError(f"{variable} is not set")
    return found


class Catalogue:
    def __init__(self, search_url: str, files_url: str, opener: Callable | None = None, sleep: Callable = time.sleep):
        self.search_url, self.files_url, self.sleep = search_url, files_url, sleep
        self.open = opener or (lambda request, timeout: urllib.request.urlopen(request, timeout=timeout))

    def _texts(self, url: str, **query) -> list[str]:
        self.sleep(SEARCH_PAUSE)
        full = f"{url}?{urllib.parse.urlencode(query)}"

        def call():
            with self.open(full, SEARCH_TIMEOUT) as r:
                return ET.fromstring(r.read())

        return [x.text.strip() for x in retried(call, sleep=self.sleep).iter() if x.text and x.text.strip()]

    def search(self, product: str, start: dt.date, end: dt.date, box, day_night: str = "N") -> list[str]:
        """Ids of a product's granules; box is (south, north, west, east)."""
        out = []
        for a, b in chunks(start, end):
            got = self._texts(
                self.search_url, products=product, startTime=a.isoformat(), endTime=f"{b.isoformat()} 23:59:59", coordsOrTiles="coords",
                dayNightBoth=day_night, south=box[0], north=box[1], west=box[2], east=box[3],
            )
            out += [x for x in got if "no results" not in x.lower()]
        return out

    def urls(self, ids: list[str]) -> list[str]:
        out = []
        for i in range(0, len(ids), ID_BATCH):
            out += [x for x in self._texts(self.files_url, fileIds=",".join(ids[i : i + ID_BATCH])) if x.startswith("http")]
        return out

    def download(self, url: str, folder: str, bearer: str) -> str:
        self.sleep(DOWNLOAD_PAUSE)
        path = os.path.join(folder, url.rsplit("/", 1)[-1])

        def call():
            request = urllib.request.Request(url, headers={"Authorization": f"Bearer {bearer}"})
            with self.open(request, DOWNLOAD_TIMEOUT) as r, open(path, "wb") as f:
                while block := r.read(1 << 20):
                    f.write(block)

        retried(call, sleep=self.sleep)
        return path
