"""Paged JSON interface as a data source: a partition for each page.

``spark.read.format("paged_comments").option("url", ...)``; the url may hold
``{offset}`` and ``{length}``. A page that can't be read, or isn't JSON, ends
the read for its offset; with ``file:`` urls it reads fixtures. With ``until``
each page begins where the one before ended, however short it was, until
there are ``total`` rows or a page is empty; one task reads them in turn.
"""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Page(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url = options["url"]
        self.length = int(options.get("length", 100))
        self.total = int(options.get("total", 200))
        self.timeout = float(options.get("timeout", 30))
        self.until = str(options.get("until", "false")).lower() == "true"

    def partitions(self):
        if self.until:
            # where a page begins depends on the rows of the one before
            return [_Page(0, self.length)]
        return [_Page(o, min(self.length, self.total - o)) for o in range(0, self.total, self.length)]

    def _rows(self, offset: int, length: int) -> list[dict] | None:
        url = self.url.replace("{offset}", str(offset)).replace("{length}", str(length))
        try:
            with urllib.request.urlopen(url, timeout=self.timeout) as f:
                return json.loads(f.read().decode("utf-8"))["rows"][:length]
        except (OSError, ValueError, KeyError):
            return None

    def read(self, page):
        as_text = lambda v: None if v is None else str(v)
        offset, stop = page.offset, self.total if self.until else page.offset + page.length
        while offset < stop:
            rows = self._rows(offset, min(page.length, stop - offset))
            if not rows:
                return
            for entry in rows:
                row = entry.get("row", {})
                yield offset, as_text(row.get("id")), as_text(row.get("text")), as_text(row.get("TOXICIDAD")), as_text(row.get("CONST"))
            offset = offset + len(rows) if self.until else stop


class PagedComments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_comments"

    def schema(self) -> str:
        return "page_offset int, id string, comentario string, toxicidad string, constructividad string"

    def reader(self, schema):
        return _Reader(self.options)


def read(spark: SparkSession, url: str, total: int = 200, length: int = 100) -> DataFrame:
    """Rows of all pages; those after the first failed page are left out, as a page-by-page reader would have stopped there."""
    from pyspark.sql import functions as F

    spark.dataSource.register(PagedComments)
    rows = spark.read.format("paged_comments").option("url", url).option("total", str(total)).option("length", str(length)).load().persist()
    seen = {r[0] for r in rows.select("page_offset").distinct().collect()}
    stop = next((o for o in range(0, total, length) if o not in seen), total)
    return rows.where(F.col("page_offset") < stop).drop("page_offset")


def read_until(spark: SparkSession, url: str, total: int, length: int = 100) -> DataFrame:
    """Up to ``total`` rows, page after page; pages may be shorter than asked for."""
    spark.dataSource.register(PagedComments)
    return spark.read.format("paged_comments").option("url", url).option("total", str(total)).option("length", str(length)).option("until", "true").load().drop("page_offset")
