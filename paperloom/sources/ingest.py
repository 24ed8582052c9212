"""Import of files: bytes, page texts and metadata behind an extractor, with a status per file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T

#: From the bytes of a document to its page texts.
Extractor = Callable[[bytes], list[str]]


def form_feed_pages(content: bytes) -> list[str]:
    """The built-in extractor: UTF-8 text with form feeds between pages. Real PDF parsing needs an extractor of the caller's."""
    return content.decode("utf-8").split("\f")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, content base64, length) of the files of a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.base64("content").alias("content"), "length")


def file_of(papers: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, content): base64 bytes of each paper's file, null where the file is missing."""
    name = F.element_at(F.split("file_path", "/"), -1)
    return papers.select("id", name.alias("name")).join(stored.select("name", "content"), "name", "left").select("id", "content")


def imported(stored: DataFrame, extractor: Extractor = form_feed_pages) -> tuple[DataFrame, DataFrame]:
    """(items, pages): per file status, error and metadata; per page its text. One bad file does not touch the others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        for frame in frames:
            rows = []
            for name, content in zip(frame["name"], frame["content"]):
                try:
                    rows.append((name, "done", None, [str(p) for p in extractor(base64.b64decode(content))]))
                except Exception as e:
                    rows.append((name, "error", f"{type(e).__name__}: {e}"[:500], []))
            yield pd.DataFrame(rows, columns=["name", "status", "error", "pages"])

    from paperloom.session import cut_lineage

    read = cut_lineage(stored.select("name", "content").mapInPandas(run, "name string, status string, error string, pages array<string>"))
    first = F.coalesce(F.try_element_at("pages", F.lit(1)), F.lit(""))
    items = read.select("name", "status", "error", T.title_of(F.lit(None).cast("string"), F.col("name")).alias("title"), T.abstract_of(first).alias("abstract"), T.year_of(first).alias("year"), F.size("pages").alias("n_pages"))
    return items, read.select("name", F.posexplode("pages").alias("page_no", "text"))


def stored_files(rows: DataFrame, folder: str) -> int:
    """Writes (id, content base64) as ``<folder>/<id>.pdf`` from the executors and returns how many; the folder must be shared."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64
        import os

        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            for row_id, content in zip(frame["id"], frame["content"]):
                final = os.path.join(folder, f"{os.path.basename(str(row_id))}.pdf")
                part = f"{final}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(base64.b64decode(content))
                os.replace(part, final)  # a repeated task writes the same bytes again
            yield pd.DataFrame({"n": [len(frame)]})

    return rows.where("content is not null").select("id", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0
