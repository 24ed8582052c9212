"""Queries over conversations and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import conversation as C
from paperloom.operators.hot import ranked
from paperloom.operators.library import numbered
from paperloom.sources import read_table

from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.add
ORDER = "timestamp NULLS FIRST, id NULLS FIRST, role NULLS FIRST, content NULLS FIRST"


@query(
    "q_conversations_nested",
    f"""WITH placed AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY {ORDER}) AS position, count(*) OVER (PARTITION BY conversation_id) AS n FROM messages)
        SELECT c.id AS conv_id, c.title, coalesce(p.n, 0) AS n_messages, p.position, p.id, p.role, p.content, p.timestamp FROM (SELECT DISTINCT id, title FROM conversations) c LEFT JOIN placed p ON p.conversation_id = c.id""",
)
def q_conversations_nested(spark: SparkSession, d: str) -> DataFrame:
    return C.placed_messages(read_table(spark, d, "conversations"), read_table(spark, d, "messages"))


@query(
    "q_transcripts",
    """WITH kept AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp DESC NULLS LAST, id DESC NULLS LAST, role DESC NULLS LAST, content DESC NULLS LAST) AS back FROM messages WHERE conversation_id IS NOT NULL)
       SELECT conversation_id, count(*) AS turns, string_agg(coalesce(role, '') || ': ' || coalesce(content, ''), E'\\n' ORDER BY back DESC) AS transcript FROM kept WHERE back <= 20 GROUP BY conversation_id""",
)
def q_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """The last 20 messages are the feature: what is sent along with a question."""
    return C.transcripts(read_table(spark, d, "messages"), 20)


@query(
    "q_recent_history",
    f"""SELECT conversation_id, id, timestamp, concat_ws(E'\\n', lag(line, 3) OVER w, lag(line, 2) OVER w, lag(line, 1) OVER w) AS history,
        CAST(count(*) OVER (PARTITION BY conversation_id ORDER BY {ORDER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS INTEGER) AS n_history
        FROM (SELECT *, coalesce(role, '') || ': ' || coalesce(content, '') AS line FROM messages) WINDOW w AS (PARTITION BY conversation_id ORDER BY {ORDER})""",
)
def q_recent_history(spark: SparkSession, d: str) -> DataFrame:
    return C.history_before(read_table(spark, d, "messages")).drop("rewrite")


@query("q_rewrite_gate", f"SELECT rewrite, count(*) AS messages FROM (SELECT count(*) OVER (PARTITION BY conversation_id ORDER BY {ORDER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) >= 2 AS rewrite FROM messages) GROUP BY rewrite")
def q_rewrite_gate(spark: SparkSession, d: str) -> DataFrame:
    return C.history_before(read_table(spark, d, "messages")).groupBy("rewrite").agg(F.count("*").alias("messages"))


@query(
    "q_prompt_window",
    f"""SELECT conversation_id, id, timestamp, count(*) OVER w AS turns, CAST(sum(length(coalesce(content, ''))) OVER w AS BIGINT) AS characters FROM messages
        WINDOW w AS (PARTITION BY conversation_id ORDER BY {ORDER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def q_prompt_window(spark: SparkSession, d: str) -> DataFrame:
    rows, order = C.looking_back(read_table(spark, d, "messages"), 19)
    w = order.rowsBetween(-19, 0)
    out = rows.select("conversation_id", "id", "timestamp", "_guest", F.count("*").over(w).alias("turns"), F.sum(F.length(F.coalesce("content", F.lit("")))).over(w).alias("characters"))
    return out.where("_guest = 0").drop("_guest")


@query(
    "q_convs_for_paper",
    """WITH named AS (SELECT DISTINCT id, created_at, unnest(paper_ids) AS paper_id FROM conversations)
       SELECT paper_id, count(DISTINCT id) AS conversations, min(created_at) AS first_created FROM named WHERE paper_id IN (SELECT id FROM papers) GROUP BY paper_id""",
)
def q_convs_for_paper(spark: SparkSession, d: str) -> DataFrame:
    return C.conversations_per_paper(read_table(spark, d, "conversations"), read_table(spark, d, "papers"))


@query("q_conv_numbering", "SELECT id, created_at, row_number() OVER (ORDER BY created_at, id, title) AS number FROM conversations WHERE created_at IS NOT NULL")
def q_conv_numbering(spark: SparkSession, d: str) -> DataFrame:
    convs = read_table(spark, d, "conversations").where("created_at is not null")
    day = F.floor(F.col("created_at") / 86_400_000)
    return numbered(convs, day, [F.col("created_at"), F.col("id"), F.col("title")], "number").select("id", "created_at", F.col("number").cast("bigint").alias("number"))


@query(
    "q_math_normalize",
    """SELECT id, timestamp, regexp_replace(regexp_replace(coalesce(content, ''), '\\\\\\[\\s*((?s:.*?))\\s*\\\\\\]', E'\\n$$\\n\\\\1\\n$$\\n', 'g'), '\\\\\\((.*?)\\\\\\)', '$\\1$', 'g') AS normalized FROM messages""",
)
def q_math_normalize(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "messages").select("id", "timestamp", T.inline_math(T.display_math(F.coalesce("content", F.lit("")))).alias("normalized"))


@query(
    "q_last_message",
    """SELECT conversation_id, id FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp DESC NULLS LAST, id DESC NULLS LAST, role DESC NULLS LAST, content DESC NULLS LAST) AS back FROM messages WHERE conversation_id IS NOT NULL) WHERE back = 1""",
)
def q_last_message(spark: SparkSession, d: str) -> DataFrame:
    return C.recent(read_table(spark, d, "messages").where("conversation_id is not null"), 1).select("conversation_id", "id")


@query(
    "q_paper_conv_numbering",
    """SELECT paper_id, id, row_number() OVER (PARTITION BY paper_id ORDER BY created_at NULLS FIRST, id, title NULLS FIRST) AS number, count(*) OVER (PARTITION BY paper_id) + 1 AS next_number
       FROM (SELECT DISTINCT id, title, created_at, unnest(paper_ids) AS paper_id FROM conversations)""",
)
def q_paper_conv_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Conversations numbered per paper, and the number the next one gets."""
    named = read_table(spark, d, "conversations").select("id", "title", "created_at", F.explode("paper_ids").alias("paper_id")).distinct()
    per = named.groupBy("paper_id").agg((F.count("*") + 1).alias("next_number"))
    placed = ranked(named, "paper_id", "created_at", [F.col("created_at"), F.col("id"), F.col("title")], "number")
    return placed.join(per, "paper_id").select("paper_id", "id", "number", "next_number")


@query("q_message_previews", "SELECT id, timestamp, substring(coalesce(content, ''), 1, 40) || CASE WHEN length(coalesce(content, '')) > 40 THEN '…' ELSE '' END AS preview, coalesce(len(sources), 0) AS n_sources FROM messages")
def q_message_previews(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "messages").select("id", "timestamp", T.preview(F.col("content"), 40).alias("preview"), F.coalesce(F.size("sources"), F.lit(0)).cast("bigint").alias("n_sources"))
