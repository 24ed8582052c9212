"""Section index: pages to boundaries, ranges, merged leaves, prompts and labels. No step needs a UDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

CHUNK = 5
MIN_PAGES = 2
TEXT_CAP = 3000


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One row per page; a repeated page keeps its greatest text, a null text is empty."""
    return pages.where("paper_id is not null and page_no is not null").groupBy("paper_id", "page_no").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))


def heading_pages(pages: DataFrame) -> DataFrame:
    return distinct_pages(pages).where(T.is_heading(F.col("text"))).select("paper_id", "page_no")


def chunk_ranges(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """(paper_id, start_page, end_page): ranges of fixed size over every paper with pages."""
    ends = pages.where("page_no is not null and paper_id is not null").groupBy("paper_id").agg(F.max("page_no").alias("last"))
    starts = ends.select("paper_id", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(size))).alias("start_page"))
    return starts.select("paper_id", "start_page", F.least(F.col("start_page") + size - 1, "last").alias("end_page"))


def heading_ranges(pages: DataFrame) -> DataFrame:
    """Ranges between headings for papers with at least two of them; pages before the first belong to a range of their own."""
    once = distinct_pages(pages).select("paper_id", "page_no", T.is_heading(F.col("text")).alias("heading"))
    facts = once.groupBy("paper_id").agg(F.max("page_no").alias("last"), F.count_if("heading").alias("headings"))
    semantic = facts.where("headings >= 2").select("paper_id", "last")
    starts = once.where("heading").select("paper_id", F.col("page_no").alias("start_page")).join(semantic, "paper_id")
    starts = starts.unionByName(semantic.select("paper_id", F.lit(0).alias("start_page"), "last")).distinct()
    order = Window.partitionBy("paper_id").orderBy("start_page")
    return starts.select("paper_id", "start_page", F.coalesce(F.lead("start_page").over(order) - 1, "last").alias("end_page"))


def merged_small(ranges: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Ranges under ``min_pages`` join the one before, a small first one the one after.

    Closed form for contiguous ranges: a group opens at the first range, and at every range of sufficient size that
    begins at least ``min_pages`` after the first start; the group number is the running count of openings.
    """
    order = Window.partitionBy("paper_id").orderBy("start_page")
    opens = (F.row_number().over(order) == 1) | (
        (F.col("start_page") - F.first("start_page").over(order) >= min_pages) & (F.col("end_page") - F.col("start_page") + 1 >= min_pages)
    )
    grouped = ranges.withColumn("_opens", opens.cast("int")).withColumn("_group", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("paper_id", "_group").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page")).drop("_group")


def leaf_ranges(pages: DataFrame) -> DataFrame:
    """(paper_id, leaf_no, start_page, end_page, semantic): the leaves of the section index."""
    semantic = merged_small(heading_ranges(pages)).withColumn("semantic", F.lit(True))
    fixed = chunk_ranges(pages).join(semantic.select("paper_id").distinct(), "paper_id", "left_anti").withColumn("semantic", F.lit(False))
    order = Window.partitionBy("paper_id").orderBy("start_page")
    return semantic.unionByName(fixed).select("paper_id", (F.row_number().over(order) - 1).alias("leaf_no"), "start_page", "end_page", "semantic")


def leaf_texts(leaves: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): pages of each range joined in order; an equi-join on page numbers, bounded by each paper's last page."""
    once = distinct_pages(pages)
    last = once.groupBy("paper_id").agg(F.max("page_no").alias("_last"))
    span = leaves.join(last, "paper_id").withColumn("_a", F.greatest("start_page", F.lit(0))).withColumn("_b", F.least("end_page", "_last")).where("_a <= _b")
    wanted = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("page_no"))
    return wanted.join(once, ["paper_id", "page_no"]).groupBy(*keys).agg(T.ordered_join(["page_no"], "text", "\n\n").alias("text"))


def leaf_prompts(leaves: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, leaf_no, label, prompt): the request for title and summary of a leaf, its text capped."""
    texts = leaf_texts(leaves, pages, ["paper_id", "leaf_no"])
    label = T.page_label(F.col("start_page"), F.col("end_page"))
    body = F.substring(F.coalesce("text", F.lit("")), 1, TEXT_CAP)
    prompt = F.concat(F.lit("Describe these pages of a paper ("), label, F.lit(").\n"), body, F.lit("\nAnswer with a JSON object holding title and summary."))
    return leaves.join(texts, ["paper_id", "leaf_no"], "left").select("paper_id", "leaf_no", label.alias("label"), prompt.alias("prompt"))


def described(replies: DataFrame, default_title: str) -> DataFrame:
    """``replies`` (with a column reply) plus title and summary, defaults where the reply is no JSON object."""
    clean = T.without_fences(F.coalesce("reply", F.lit("")))
    parsed = F.from_json(F.when(clean.rlike(r"^\{(?s).*\}$"), clean), "title string, summary string", {"allowSingleQuotes": "false"})
    return replies.withColumn("_p", parsed).withColumn("title", T.filled(F.col("_p.title"), F.col(default_title))).withColumn("summary", F.coalesce("_p.summary", F.lit(""))).drop("_p")


def build_index(pages: DataFrame, model=None, papers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(roots, leaves) of all papers with pages: one model call per leaf, one more per paper with several leaves.

    A paper of ``papers`` (column id) without any page gets a root that ends at page -1 and has no leaves, by one call.
    """
    from paperloom.functions.model_call import offline_reply, with_reply

    model = model or offline_reply
    ranges = leaf_ranges(pages)
    asked = with_reply(leaf_prompts(ranges, pages), "prompt", "reply", model)
    leaves = described(asked, "label").select("paper_id", "leaf_no", "title", "summary").join(ranges, ["paper_id", "leaf_no"])
    leaves = leaves.select("paper_id", "leaf_no", "title", "summary", "start_page", "end_page")
    entry = F.concat(F.lit("["), (F.col("leaf_no") + 1).cast("string"), F.lit("] "), "title", F.lit(": "), "summary")
    per = leaves.withColumn("entry", entry).groupBy("paper_id").agg(F.count("*").cast("int").alias("n_leaves"), T.ordered_join(["leaf_no"], "entry", "\n").alias("listing"), F.max("end_page").alias("end_page"), F.min_by("title", "leaf_no").alias("only_title"), F.min_by("summary", "leaf_no").alias("only_summary"))
    if papers is not None:
        bare = papers.select(F.col("id").alias("paper_id")).where("paper_id is not null").distinct().join(per.select("paper_id"), "paper_id", "left_anti")
        per = per.unionByName(bare.select("paper_id", F.lit(0).alias("n_leaves"), F.lit("").alias("listing"), F.lit(-1).alias("end_page")), allowMissingColumns=True)
    several = per.where("n_leaves != 1").withColumn("prompt", F.concat(F.lit("Outline a paper with these sections.\n"), "listing", F.lit("\nAnswer with a JSON object holding title and summary."))).withColumn("label", F.lit("Paper"))
    roots = described(with_reply(several, "prompt", "reply", model), "label").select("paper_id", "title", "summary", F.lit(0).alias("start_page"), "end_page", "n_leaves")
    single = per.where("n_leaves = 1").select("paper_id", F.col("only_title").alias("title"), F.col("only_summary").alias("summary"), F.lit(0).alias("start_page"), "end_page", "n_leaves")
    return roots.unionByName(single), leaves


def missing_index(papers: DataFrame, leaves: DataFrame, in_flight: DataFrame | None = None) -> DataFrame:
    """Ids of papers that still need an index; those in work are left alone."""
    out = papers.select("id").distinct().join(leaves.select(F.col("paper_id").alias("id")).distinct(), "id", "left_anti")
    return out if in_flight is None else out.join(in_flight.select("id"), "id", "left_anti")
