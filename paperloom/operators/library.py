"""Collections and papers: lists, lookups, counts, cards, cascades of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

STATUS_LABELS = {"unread": "Unread", "reading": "Reading", "done": "Done"}
#: Stages of an import in order, with their labels; a failure ends it at any stage.
STAGES = ("pending", "parsing", "saving", "done")
STAGE_LABELS = {"pending": "Waiting", "parsing": "Reading the file", "saving": "Saving", "done": "Done", "error": "Failed"}


def listed_collections(kbs: DataFrame) -> DataFrame:
    """Collections with their place in creation order. One global window: collections are few (tens), never data-sized."""
    return kbs.withColumn("position", F.row_number().over(Window.orderBy("created_at", "id")))


def collection_successor(kbs: DataFrame) -> DataFrame:
    """(id, next_id): the next collection in list order, the last wraps to the first."""
    order = Window.orderBy("created_at", "id")
    first = F.first_value("id").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return kbs.select("id", F.coalesce(F.lead("id").over(order), first).alias("next_id"))


def successor_of(requests: DataFrame, kbs: DataFrame) -> DataFrame:
    """(request, next_id): the collection after the asked one (column kb_id); an unknown one is followed by the first of the list."""
    first = kbs.agg(F.min(F.struct("created_at", "id"))["id"].alias("_first"))
    after = collection_successor(kbs).select(F.col("id").alias("kb_id"), "next_id")
    return requests.join(after, "kb_id", "left").join(first, F.lit(True), "left").select("request", F.coalesce("next_id", "_first").alias("next_id"))


def newest_first(df: DataFrame, time: str, then: list[Column], name: str = "position") -> DataFrame:
    """``df`` with its place in a list that shows the newest first, rows without a time last."""
    known = F.col(time).isNotNull()
    day = F.when(known, -F.floor(F.col(time) / 86_400_000)).otherwise(F.lit(1 << 60))
    return numbered(df, day, [F.desc_nulls_last(time), *then], name)


def numbered(df: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Global row numbers without a global sort: numbers within buckets plus the sizes of the buckets before.

    ``bucket`` must rise with the order. Only one row per bucket meets in the single-partition window.
    """
    held = df.withColumn("_bucket", bucket)
    before = held.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = before.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    inside = held.withColumn("_at", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    same = F.col("_bucket").eqNullSafe(F.col("_other"))
    return inside.join(before.withColumnRenamed("_bucket", "_other"), same).withColumn(name, F.col("_at") + F.col("_before")).drop("_bucket", "_other", "_at", "_before")


def papers_in(papers: DataFrame, kb_id: str) -> DataFrame:
    return papers.where(F.col("knowledge_base_id") == kb_id)


def paper_by_id(papers: DataFrame, paper_id: str | Column) -> DataFrame:
    """No row stands for null."""
    return papers.where(F.col("id") == paper_id)


def collection_counts(kbs: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers per collection, zeros included; papers are counted before the join, so one collection that holds a third of them costs nothing."""
    counts = papers.groupBy("knowledge_base_id").agg(F.count("id").alias("n"))
    return kbs.join(counts, kbs.id == counts.knowledge_base_id, "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("papers"))


def cards(papers: DataFrame) -> DataFrame:
    """What a list shows of a paper: title, authors, year, preview of the abstract, two tags, label of the status."""
    labels = F.create_map(*(F.lit(x) for pair in STATUS_LABELS.items() for x in pair))
    return papers.select(
        "id",
        T.filled(F.col("title"), F.col("file_name")).alias("display_title"),
        T.filled(F.array_join("authors", ", "), F.lit("Unknown authors")).alias("display_authors"),
        F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("Unknown")).alias("first_author"),
        F.coalesce(F.nullif(F.col("year"), F.lit(0)).cast("string"), F.lit("—")).alias("display_year"),
        T.preview(F.col("abstract"), 120).alias("preview"),
        F.array_join(F.slice("tags", 1, 2), ", ").alias("shown_tags"),
        F.coalesce(labels[F.col("status")], F.col("status")).alias("status_label"),
        F.when(F.col("status") == "unread", "reading").otherwise(F.col("status")).alias("status_after_opening"),
    )


def indexed_ids(leaves: DataFrame) -> DataFrame:
    return leaves.where("paper_id is not null").select(F.col("paper_id").alias("id")).distinct()


def badges(papers: DataFrame, leaves: DataFrame, in_flight: DataFrame | None = None) -> DataFrame:
    """(id, badge): indexed; indexing, where ``in_flight`` (ids) is given and no index is there yet; or none."""
    marked = indexed_ids(leaves).withColumn("_indexed", F.lit(True))
    out = papers.select("id").join(marked, "id", "left")
    busy = F.lit(False)
    if in_flight is not None:
        out = out.join(in_flight.select("id").distinct().withColumn("_busy", F.lit(True)), "id", "left")
        busy = F.coalesce("_busy", F.lit(False))
    return out.select("id", F.when(F.col("_indexed"), "indexed").when(busy, "indexing").otherwise("none").alias("badge"))


def advanced(status: Column, failed: Column) -> Column:
    """The stage after ``status``: the next one, or error; an ended import stays."""
    out = status
    for now, then in zip(STAGES, STAGES[1:]):
        out = F.when((status == now) & failed, "error").when(status == now, then).otherwise(out)
    return out


def stage_label(status: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in STAGE_LABELS.items() for x in pair))
    return F.coalesce(labels[status], status)


def toggled(array: str, element: Column) -> Column:
    """The array without the element if it is there, else with it at the end."""
    return F.when(F.array_contains(array, element), F.array_remove(array, element)).otherwise(F.array_append(array, element))


def added_to(array: str, element: Column) -> Column:
    """The array as a set that holds the element."""
    return F.array_union(F.coalesce(array, F.array().cast("array<string>")), F.array(element))


def deletable(kbs: DataFrame) -> DataFrame:
    return kbs.where(F.col("id") != "default")


def import_progress(items: DataFrame, by: str) -> DataFrame:
    """Per group: items, finished ones, percent, whether all are finished, whether any failed. Items carry status done, error or an earlier stage."""
    ended = F.col("status").isin("done", "error")
    out = items.groupBy(by).agg(F.count("*").alias("items"), F.count_if(ended).alias("ended"), F.bool_or(F.col("status") == "error").alias("any_error"))
    return out.withColumn("all_ended", (F.col("items") > 0) & (F.col("items") == F.col("ended"))).withColumn("percent", F.floor(F.col("ended") * 100 / F.col("items") + 0.5).cast("long"))
