"""Folder listing as a Data Source whose partitions are pages of the listing.

The folder is walked once, when the read is planned.  A page is closed at a
number of names or at a sum of file sizes, written to the cluster's shared
checkpoint folder, and becomes one partition: no process holds all names, the
tasks that read the files follow their bytes, and a task that runs again sees
the page it saw before, whatever happened to the folder since.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ensure_checkpoint_dir, ship_package
from .storage import absolute, files_in, open_fs

PAGE_FILES, PAGE_BYTES = 10_000, 128 << 20
OPEN_BYTES = 4 << 20            # what opening a file counts, as in Spark's own packing
LISTED_OPEN_BYTES = 16 << 10    # the same in :func:`listing`: folders of small files have thousands to a page
SCHEMA = "path string, name string, length long"


@dataclass
class Page(InputPartition):
    """A written page; an empty folder has one page without a file."""
    path: str | None


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.pages = options["path"], options["pages"].rstrip("/")
        self.most_files, self.most_bytes = int(options.get("files", PAGE_FILES)), int(options.get("bytes", PAGE_BYTES))
        self.open_bytes = int(options.get("open", OPEN_BYTES))

    def _cut(self) -> Iterator[list[tuple[str, str, int]]]:
        page: list[tuple[str, str, int]] = []
        held = 0
        for f in files_in(self.folder):
            cost = self.open_bytes + f[2]
            if page and (len(page) >= self.most_files or held + cost > self.most_bytes):
                yield page
                page, held = [], 0
            page.append(f)
            held += cost
        if page:
            yield page

    def partitions(self) -> list[Page]:
        system, place = open_fs(self.pages)
        run = uuid.uuid4().hex
        system.create_dir(f"{place}/{run}", recursive=True)
        found = []
        for i, page in enumerate(self._cut()):
            with system.open_output_stream(f"{place}/{run}/{i}.json") as out:
                out.write(json.dumps(page).encode())
            found.append(Page(f"{self.pages}/{run}/{i}.json"))
        return found or [Page(None)]

    def read(self, partition: Page) -> Iterator[tuple[str, str, int]]:
        if partition.path is not None:
            system, place = open_fs(partition.path)
            with system.open_input_stream(place) as f:
                yield from map(tuple, json.loads(f.read()))


class FolderListing(DataSource):
    """``path``: the folder; ``pages``: a shared folder for the pages; ``files``, ``bytes``: where a page is closed; ``open``: bytes that opening a file counts."""

    @classmethod
    def name(cls) -> str:
        return "spanmask_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def listing(spark: SparkSession, folder: str, files: int = PAGE_FILES, size: int = PAGE_BYTES) -> DataFrame:
    """(path, name, length) of the files directly in ``folder``, hidden and empty ones included, a page to a partition."""
    ship_package(spark)
    spark.dataSource.register(FolderListing)
    return (spark.read.format(FolderListing.name()).option("path", absolute(folder))
            .option("pages", f"{ensure_checkpoint_dir(spark)}/listing").option("files", files).option("bytes", size)
            .option("open", LISTED_OPEN_BYTES).load())
