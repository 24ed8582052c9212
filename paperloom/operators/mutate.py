"""Changes of tables as pure functions: a table and a change in, the next snapshot out.

Write the result to a new folder; never overwrite the path that is being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.schema import DEFAULT_KB


def inserted(table: DataFrame, rows: DataFrame, key: str, parent: DataFrame | None = None, foreign_key: str | None = None) -> DataFrame:
    """``table`` with the rows whose key is new and whose parent exists."""
    fresh = rows.join(table.select(key), key, "left_anti")
    if parent is not None:
        fresh = fresh.join(parent.select(F.col("id").alias(foreign_key)).distinct(), foreign_key, "left_semi")
    return table.unionByName(fresh.select(*table.columns))


def stamped(rows: DataFrame, time: str) -> DataFrame:
    """New rows with a fresh id and the present time in milliseconds; not repeatable, so write the result before reading it twice."""
    return rows.withColumn("id", F.expr("uuid()")).withColumn(time, F.unix_millis(F.current_timestamp()))


def papers_added(papers: DataFrame, rows: DataFrame, kbs: DataFrame) -> DataFrame:
    """``papers`` with new ones of known collections; what a row carries beyond the table's columns (the file's bytes) is not stored."""
    return inserted(papers, rows, "id", kbs, "knowledge_base_id")


def upserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``rows`` replace those of the same key."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows.select(*table.columns))


def without(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``table`` without the rows whose ``column`` occurs in ``keys`` (one column, any name)."""
    gone = keys.select(F.col(keys.columns[0]).alias(column)).distinct()
    return table.join(gone, column, "left_anti").select(*table.columns)


def collections_removed(kb_ids: DataFrame, kbs: DataFrame, papers: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Removal of collections with their papers and whatever hangs on those by ``paper_id``."""
    gone_ids = kb_ids.select(F.col(kb_ids.columns[0]).alias("knowledge_base_id")).distinct()
    gone_papers = papers.join(gone_ids, "knowledge_base_id", "left_semi").select("id")
    out = {"knowledge_bases": without(kbs, kb_ids, "id"), "papers": papers.join(gone_ids, "knowledge_base_id", "left_anti").select(*papers.columns)}
    return out | {name: without(df, gone_papers, "paper_id") for name, df in children.items()}


def papers_removed(paper_ids: DataFrame, papers: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {"papers": without(papers, paper_ids, "id")} | {name: without(df, paper_ids, "paper_id") for name, df in children.items()}


def conversations_removed(ids: DataFrame, conversations: DataFrame, messages: DataFrame) -> dict[str, DataFrame]:
    return {"conversations": without(conversations, ids, "id"), "messages": without(messages, ids, "conversation_id")}


PATCHABLE = ("title", "abstract", "year", "status", "knowledge_base_id")
REPLACED = ("authors", "tags")


def papers_patched(papers: DataFrame, patches: DataFrame) -> DataFrame:
    """Null keeps the old value of ``PATCHABLE``; lists are replaced, even by null, where ``set_authors`` / ``set_tags`` is true. Unknown ids change nothing; file names, paths and times never change."""
    new = patches.select(F.col("id"), *(F.col(c).alias(f"_{c}") for c in patches.columns if c != "id"))
    joined = papers.join(new, "id", "left")
    out = {c: F.coalesce(f"_{c}", c) for c in PATCHABLE if f"_{c}" in new.columns}
    for c in REPLACED:
        if f"_{c}" in new.columns:
            out[c] = F.when(F.coalesce(f"_set_{c}", F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c))
    return joined.select(*(out.get(c, F.col(c)).alias(c) for c in papers.columns))


def conversations_patched(conversations: DataFrame, patches: DataFrame) -> DataFrame:
    """A null title and null paper ids keep the old values; an empty list replaces."""
    new = patches.select("id", F.col("title").alias("_title"), F.col("paper_ids").alias("_paper_ids"))
    return conversations.join(new, "id", "left").select("id", F.coalesce("_title", "title").alias("title"), F.coalesce("_paper_ids", "paper_ids").alias("paper_ids"), "created_at")


def seeded(kbs: DataFrame, created_at: int) -> DataFrame:
    """A table without collections gets the default one."""
    empty = kbs.agg(F.count("*").alias("n")).where("n = 0")
    row = empty.select(*(F.lit(DEFAULT_KB[c]).alias(c) for c in ("id", "name", "description", "color")), F.lit(created_at).cast("bigint").alias("created_at"))
    return kbs.unionByName(row)


def cleared(tables: dict[str, DataFrame], created_at: int) -> dict[str, DataFrame]:
    """All tables empty, then the default collection."""
    empty = {name: df.where(F.lit(False)) for name, df in tables.items()}
    return empty | {"knowledge_bases": seeded(empty["knowledge_bases"], created_at)}
