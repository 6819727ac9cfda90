"""Search results in pages, as a Spark data source.

Page k of a search is the file `page-k.json` in a folder, an object whose
`objects` are `page_size` hits and whose `total` tells how many there are. The
pages that hold `from` to `from + size` are the partitions of a batch read, so
what isn't asked for is never opened; the hits of a page are read one at a
time. As a stream, pages are taken as they arrive, in order, from `from` on; a
restart goes on after the last page that was committed, and a page that isn't
whole yet is left for later.

    spark.dataSource.register(PagedSearch)
    spark.read.format("paged_search").option("from", 40).load(folder)
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "at long, name string, version string, score double, package string"
CHUNK = 1 << 16
PAGE = re.compile(r"page-(\d+)\.json$")


def elements(read: Callable[[int], bytes], key: str) -> Iterator[object]:
    """The elements of the array under `key` of an object, one at a time: no
    more is held than one element and a chunk. read(n) gives the next n bytes,
    none at the end. A text that ends too early is a ValueError."""
    decoder, raw, text, at, inside = json.JSONDecoder(), b"", "", 0, False
    mark = re.compile(rf'"{re.escape(key)}"\s*:\s*\[')
    while True:
        chunk = read(CHUNK)
        raw += chunk
        good = raw.decode("utf-8", "ignore") if chunk else raw.decode("utf-8")
        raw = raw[len(good.encode()) :]
        text, at = text[at:] + good, 0
        if not inside:
            found = mark.search(text)
            if not found:
                if not chunk:
                    return
                continue
            at, inside = found.end(), True
        while True:
            while at < len(text) and text[at] in ", \t\r\n":
                at += 1
            if at < len(text) and text[at] == "]":
                return
            try:
                value, end = decoder.raw_decode(text, at)
            except ValueError:
                break
            if end == len(text) or text[end] not in ",] \t\r\n":
                break  # a number may go on in the next chunk
            yield value
            at = end
        if not chunk:
            raise ValueError(f"the array {key!r} isn't whole")


class Pages:
    """A folder of pages in any store that pyarrow knows."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.page_size, self.first, self.size = (int(options.get(k, d)) for k, d in (("page_size", 20), ("from", 0), ("size", -1)))
        self.retries, self.wait = int(options.get("retries", 2)), float(options.get("wait", 0.1))

    def at(self):
        from pyarrow import fs

        if "://" not in self.path and not self.path.startswith("file:"):
            return fs.LocalFileSystem(), self.path
        return fs.FileSystem.from_uri(self.path)

    def known(self) -> list[int]:
        """The numbers of the pages that there are."""
        from pyarrow import fs

        store, path = self.at()
        found = store.get_file_info(fs.FileSelector(path))
        return sorted(int(m[1]) for f in found if (m := PAGE.search(f.path)))

    def hits(self, page: int) -> Iterator[tuple]:
        """The page's hits that were asked for. A failure is tried again some
        times, then told with the page; hits that were given aren't given twice."""
        store, path = self.at()
        given = 0
        for left in range(self.retries, -1, -1):
            try:
                with store.open_input_stream(f"{path}/page-{page}.json") as f:
                    for k, hit in enumerate(elements(f.read, "objects")):
                        at = page * self.page_size + k
                        if k < given or at < self.first or (self.size >= 0 and at >= self.first + self.size):
                            continue
                        p = hit.get("package", {})
                        yield at, p.get("name"), p.get("version"), (hit.get("score") or {}).get("final"), json.dumps(p, sort_keys=True)
                        given = k + 1
                return
            except (OSError, ValueError) as e:
                if not left:
                    raise RuntimeError(f"page {page} of {self.path} couldn't be read: {e}") from e
                time.sleep(self.wait)

    def wanted(self, known: list[int]) -> list[int]:
        last = max(known, default=-1) if self.size < 0 else (self.first + self.size - 1) // self.page_size
        return [k for k in known if self.first // self.page_size <= k <= last]


class Page(InputPartition):
    def __init__(self, page: int):
        self.page = page


class BatchReader(DataSourceReader):
    def __init__(self, pages: Pages):
        self.pages = pages

    def partitions(self):
        return [Page(k) for k in self.pages.wanted(self.pages.known())]

    def read(self, partition):
        yield from self.pages.hits(partition.page)


class StreamReader(DataSourceStreamReader):
    """Offsets are page numbers: the next page that hasn't been taken. Pages stay where they are."""

    def __init__(self, pages: Pages):
        self.pages = pages
        self.first = self.next = pages.first // pages.page_size

    def initialOffset(self):
        return {"page": self.first}

    def latestOffset(self):
        known = set(self.pages.wanted(self.pages.known()))
        while self.next in known and self._whole(self.next):
            self.next += 1
        return {"page": self.next}

    def _whole(self, page: int) -> bool:
        store, path = self.pages.at()
        try:
            with store.open_input_stream(f"{path}/page-{page}.json") as f:
                for _ in elements(f.read, "objects"):
                    pass
        except (OSError, ValueError):
            return False
        return True

    def partitions(self, start, end):
        self.next = max(self.next, end["page"])
        return [Page(k) for k in range(start["page"], end["page"])]

    def read(self, partition):
        yield from self.pages.hits(partition.page)


class PagedSearch(DataSource):
    """Options: path, page_size (20), from (0), size (all), retries (2), wait (0.1 s)."""

    @classmethod
    def name(cls):
        return "paged_search"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BatchReader(Pages(self.options))

    def streamReader(self, schema):
        return StreamReader(Pages(self.options))
