"""Conversations: nested lists, transcripts, recent history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hot import neighbourly, ranked

#: The order of a conversation's messages; equal times by id, then by content, so that repeated rows have a fixed place too.
ORDER = ("timestamp", "id", "role", "content")


def in_places(messages: DataFrame, name: str = "position", **options: int) -> DataFrame:
    """``messages`` with their place in their conversation, of any length."""
    return ranked(messages, "conversation_id", "timestamp", [F.col(c) for c in ORDER], name, **options)


def looking_back(messages: DataFrame, back: int, **options: int) -> tuple[DataFrame, Window]:
    """(rows, window): a window over these rows sees up to ``back`` rows before each; keep those with ``_guest = 0`` afterwards."""
    rows = neighbourly(in_places(messages, "_place", **options), "_place", back)
    return rows, Window.partitionBy("conversation_id", "_block").orderBy("_place")


def placed_messages(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per message of a known conversation with its position and the number of messages; conversations without any keep one row with nulls."""
    per = messages.groupBy("conversation_id").agg(F.count("*").alias("n_messages"))
    placed = in_places(messages)
    heads = conversations.select(F.col("id").alias("conv_id"), "title").distinct()
    out = heads.join(placed, heads.conv_id == placed.conversation_id, "left").drop("conversation_id")
    return out.join(per, out.conv_id == per.conversation_id, "left").select("conv_id", "title", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), "position", "id", "role", "content", "timestamp")


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of every conversation with their place from the end."""
    back = Window.partitionBy("conversation_id").orderBy(F.desc("timestamp"), F.desc("id"), F.desc("role"), F.desc("content"))
    return messages.withColumn("from_end", F.row_number().over(back)).where(F.col("from_end") <= n)


def line(role: str = "role", content: str = "content") -> Column:
    return F.concat(F.coalesce(role, F.lit("")), F.lit(": "), F.coalesce(content, F.lit("")))


def transcripts(messages: DataFrame, n: int) -> DataFrame:
    """(conversation_id, turns, transcript) over the last ``n`` messages: the window bounds the group that is collected."""
    kept = recent(messages.where("conversation_id is not null"), n).select("conversation_id", F.struct((-F.col("from_end")).alias("at"), line().alias("line")).alias("r"))
    rows = F.array_sort(F.collect_list("r"))
    return kept.groupBy("conversation_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("transcript"))


def history_before(messages: DataFrame, n: int = 3) -> DataFrame:
    """Each message with the ``n`` before it as lines, and whether there are enough of them to rewrite a question."""
    rows, w = looking_back(messages, n)
    before = [F.lag(line(), k).over(w) for k in range(n, 0, -1)]
    out = rows.select("conversation_id", "id", "timestamp", "_guest", F.concat_ws("\n", *before).alias("history"), sum(b.isNotNull().cast("int") for b in before).alias("n_history"))
    return out.where("_guest = 0").drop("_guest").withColumn("rewrite", F.col("n_history") >= 2)


def up_to(messages: DataFrame, ends: DataFrame) -> DataFrame:
    """Messages of the conversations in ``ends`` (conversation_id, end: struct of timestamp and id), up to that message: what was said when it was asked."""
    return messages.join(ends.select("conversation_id", "end"), "conversation_id").where(F.struct("timestamp", "id") <= F.col("end")).drop("end")


def containing(conversations: DataFrame, paper_id: Column) -> DataFrame:
    """Conversations that name the paper."""
    return conversations.where(F.array_contains("paper_ids", paper_id))


def newest_per_paper(conversations: DataFrame) -> DataFrame:
    """(paper_id, id): the first conversation that a paper's list shows, the newest."""
    named = conversations.select("id", "created_at", F.explode("paper_ids").alias("paper_id"))
    first = F.min(F.struct(F.col("created_at").isNull().alias("none"), (-F.col("created_at")).alias("back"), "id"))
    return named.groupBy("paper_id").agg(first["id"].alias("id"))


def conversations_per_paper(conversations: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, conversations, first_created): conversations that name a paper of the library; dangling ids fall away."""
    named = conversations.select("id", "created_at", F.explode(F.array_distinct("paper_ids")).alias("paper_id"))
    per = named.groupBy("paper_id").agg(F.count_distinct("id").alias("conversations"), F.min("created_at").alias("first_created"))
    return per.join(papers.select(F.col("id").alias("paper_id")).distinct(), "paper_id")
