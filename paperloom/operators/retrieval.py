"""Selection of sections by scores, context assembly and the answer pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

from .sections import build_index, leaf_texts, missing_index

SECOND_SCORE = 4
PAPER_BREAK = "\n\n---\n\n"
MATH_NOTE = "Write formulas between dollar signs."


def score_rows(replies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, id, score) from raw replies; a reply that is no JSON array of objects has no row. Scores written as text count as numbers."""
    clean = T.without_fences(F.coalesce("reply", F.lit("")))
    listed = F.when(clean.rlike(r"(?s)^\[.*\]$"), clean)
    rows = F.from_json(listed, "array<struct<id:string,score:string>>", {"allowSingleQuotes": "false"})
    out = replies.select(*keys, F.posexplode(rows).alias("pos", "r"))
    return out.select(*keys, "pos", F.col("r.id").try_cast("int").alias("id"), F.col("r.score").try_cast("double").alias("score"))


def selected_leaves(scores: DataFrame, leaves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, leaf_no, start_page, end_page, title, selection_status).

    The best score is always kept, the second from ``SECOND_SCORE`` on; equal scores in reply order. One leaf needs no
    scores (``single``); without usable scores the first leaf stands in (``fallback``); an id outside the leaves is an
    error of its own (``invalid_id``).
    """
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("score"), "pos")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    picked = ranked.where((F.col("rank") == 1) | ((F.col("rank") == 2) & (F.col("score") >= SECOND_SCORE)))
    sizes = leaves.groupBy(*keys).agg(F.count("*").alias("n_leaves"))
    wanted = sizes.join(picked.select(*keys, "rank", F.col("id").alias("picked_id")), keys, "left")
    wanted = wanted.where((F.col("n_leaves") > 1) | F.col("rank").isNull() | (F.col("rank") == 1))
    leaf = F.when(F.col("n_leaves") == 1, 0).otherwise(F.when(F.col("rank").isNull(), 0).otherwise(F.col("picked_id")))
    status = F.when(F.col("n_leaves") == 1, "single").when(F.col("rank").isNull(), "fallback").otherwise("scored")
    wanted = wanted.select(*keys, leaf.alias("leaf_no"), status.alias("status"), F.coalesce("rank", F.lit(1)).alias("rank"))
    known = leaves.select(*keys, "leaf_no", "start_page", "end_page", "title", F.lit(True).alias("_known"))
    out = wanted.join(known, [*keys, "leaf_no"], "left")
    return out.select(*keys, "leaf_no", "rank", "start_page", "end_page", "title", F.when(F.col("_known"), F.col("status")).otherwise("invalid_id").alias("selection_status"))


def paper_contexts(selected: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, context, sources, n_selected): texts and labels of the selected leaves in document order."""
    chosen = selected.where("selection_status != 'invalid_id'")
    texts = leaf_texts(chosen, pages, ["paper_id", "leaf_no", "rank"])
    full = chosen.join(texts, ["paper_id", "leaf_no", "rank"], "left").withColumn("label", T.source_label(F.col("start_page"), F.col("end_page"), F.col("title")))
    return full.groupBy("paper_id").agg(
        T.ordered_join(["start_page", "rank"], "text", PAPER_BREAK).alias("context"), T.ordered_join(["start_page", "rank"], "label", " | ").alias("sources"), F.count("*").alias("n_selected")
    )


def conversation_contexts(conversations: DataFrame, contexts: DataFrame) -> DataFrame:
    """(conversation_id, papers, context, sources): contexts of a conversation's papers in its own order; papers without an index are left out."""
    named = conversations.select(F.col("id").alias("conversation_id"), "paper_ids").distinct().select("conversation_id", F.posexplode("paper_ids").alias("pos", "paper_id"))
    joined = named.join(contexts, "paper_id")
    return joined.groupBy("conversation_id").agg(F.count("*").alias("papers"), T.ordered_join(["pos", "paper_id"], "context", PAPER_BREAK).alias("context"), T.ordered_join(["pos", "paper_id"], "sources", " | ").alias("sources"))


def final_context(manual: Column, retrieved: Column) -> Column:
    """Snippets that the user picked replace everything retrieved."""
    return F.when(T.trimmed(F.coalesce(manual, F.lit(""))) != "", manual).otherwise(F.coalesce(retrieved, F.lit("")))


def system_message(prompt: Column, context: Column) -> Column:
    return F.concat(prompt, F.lit("\n\n" + MATH_NOTE), F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("\n\nReference material:\n"), context)).otherwise(""))


def rewritten(reply: Column, query: Column) -> Column:
    """A blank rewriting falls back to the question."""
    return F.coalesce(F.nullif(T.trimmed(reply), F.lit("")), query)


def rating_prompt(leaves: DataFrame, questions: DataFrame) -> DataFrame:
    """(paper_id, query, prompt) for papers with several leaves."""
    listing = leaves.withColumn("entry", F.concat(F.lit("["), F.col("leaf_no").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("summary", F.lit(""))))
    per = listing.groupBy("paper_id").agg(F.count("*").alias("n"), T.ordered_join(["leaf_no"], "entry", "\n").alias("sections")).where("n > 1")
    return questions.join(per, "paper_id").withColumn("prompt", F.concat(F.lit("Rate how well each section answers the question, 0 to 10.\nQuestion: "), "query", F.lit("\n"), "sections", F.lit("\nAnswer with a JSON array of objects holding id and score."))).select("paper_id", "query", "prompt")


def answer(conversations: DataFrame, messages: DataFrame, leaves: DataFrame, pages: DataFrame, system: str = "You help with reading papers.", model=None) -> DataFrame:
    """``answers`` for the conversations with a paper in ``leaves`` only; no index is built."""
    return answers(conversations, messages, leaves, pages, system, model, only_indexed=True)


def answers(conversations: DataFrame, messages: DataFrame, leaves: DataFrame, pages: DataFrame, system: str = "You help with reading papers.", model=None, only_indexed: bool = False) -> DataFrame:
    """(conversation_id, question, query, context_chars, sources, reply) for the last user message of every known conversation.

    Stages: the index of asked papers that have pages but no leaves, the rewriting (only with papers, and with at least two
    earlier messages among the last three), the rating of sections (only for papers with several leaves), the answer.
    Papers without pages or index are left out; without any other, the context and the sources are empty. Rows are filtered
    before each model call, and replies materialised.
    """
    from paperloom.functions.model_call import model_column, offline_reply
    from paperloom.session import cut_lineage

    from .conversation import history_before, transcripts, up_to

    model = model or offline_reply

    def replied(df: DataFrame, reply: str) -> DataFrame:
        """``df`` with materialised replies in place of its prompts, which would fill the checkpoint folder."""
        return cut_lineage(df.withColumn(reply, model_column(model)(F.col("prompt"))).drop("prompt"))

    asked = messages.where((F.lower(F.trim("role")).isin("user", "human")) & F.col("content").isNotNull() & F.col("conversation_id").isNotNull())
    last = asked.groupBy("conversation_id").agg(F.max(F.struct("timestamp", "id", "content")).alias("m")).select("conversation_id", F.col("m.id").alias("id"), F.col("m.content").alias("question"), F.struct("m.timestamp", "m.id").alias("end"))
    history = history_before(messages).groupBy("conversation_id", "id").agg(F.max(F.struct("rewrite", "history")).alias("h"))
    turns = last.join(history, ["conversation_id", "id"]).select("conversation_id", "question", "h.rewrite", "h.history")
    known = conversations.select(F.col("id").alias("conversation_id"), "paper_ids").dropDuplicates(["conversation_id"])
    turns = turns.join(known.select("conversation_id", F.coalesce(F.size("paper_ids") > 0, F.lit(False)).alias("with_papers")), "conversation_id")
    to_rewrite = turns.where("rewrite and with_papers").withColumn("prompt", F.concat(F.lit("Rewrite the last question so that it stands alone.\n"), "history", F.lit("\nQuestion: "), "question"))
    rewritings = replied(to_rewrite.select("conversation_id", "prompt"), "rewriting")
    turns = turns.join(rewritings.select("conversation_id", "rewriting"), "conversation_id", "left").withColumn("query", rewritten(F.col("rewriting"), F.col("question")))
    turns = cut_lineage(turns.select("conversation_id", "question", "query"))
    pairs = known.select("conversation_id", F.posexplode("paper_ids").alias("pos", "paper_id")).join(turns, "conversation_id")
    if not only_indexed:
        missing = missing_index(pairs.select(F.col("paper_id").alias("id")), leaves).withColumnRenamed("id", "paper_id")
        # the index that a first question builds; a paper without pages gets no leaf and stays out of the context
        unread = cut_lineage(pages.join(missing, "paper_id", "left_semi"))
        if not unread.isEmpty():
            built = cut_lineage(build_index(unread, model)[1])
            leaves = leaves.select(*built.columns).unionByName(built)
    ratings = replied(rating_prompt(leaves, pairs.select("paper_id", "query").distinct()), "reply")
    keys = ["paper_id", "query"]
    per_query = pairs.select("paper_id", "query").distinct().join(leaves, "paper_id")
    chosen = selected_leaves(score_rows(ratings, keys), per_query, keys).where("selection_status != 'invalid_id'")
    texts = leaf_texts(chosen, pages, ["paper_id", "query", "leaf_no", "rank"])
    contexts = chosen.join(texts, ["paper_id", "query", "leaf_no", "rank"], "left").withColumn("label", T.source_label(F.col("start_page"), F.col("end_page"), F.col("title")))
    contexts = contexts.groupBy("paper_id", "query").agg(T.ordered_join(["start_page", "rank"], "text", PAPER_BREAK).alias("context"), T.ordered_join(["start_page", "rank"], "label", " | ").alias("sources"))
    gathered = pairs.join(contexts, keys).groupBy("conversation_id").agg(T.ordered_join(["pos"], "context", PAPER_BREAK).alias("context"), T.ordered_join(["pos"], "sources", " | ").alias("sources"))
    gathered = turns.select("conversation_id", "question", "query").join(gathered, "conversation_id", "inner" if only_indexed else "left").fillna("", ["context", "sources"])
    window = transcripts(up_to(messages, last.select("conversation_id", "end")), 20)
    ready = gathered.join(window, "conversation_id").withColumn("prompt", F.concat(system_message(F.lit(system), F.col("context")), F.lit("\n\n"), "transcript"))
    return replied(ready.select("conversation_id", "question", "query", F.length("context").alias("context_chars"), "sources", "prompt"), "reply")


def exchanged(replies: DataFrame, now: int) -> DataFrame:
    """The rows that an answered question adds to ``messages``: the assistant's message with its sources; the user's stands there already, stored before the model is asked."""
    said = F.filter(F.split("sources", r" \| "), lambda x: x != "")
    return replies.where("reply is not null").select(
        F.concat(F.lit("reply-"), F.md5(F.concat_ws("|", "conversation_id", "question"))).alias("id"), "conversation_id", F.lit("assistant").alias("role"), F.col("reply").alias("content"), said.alias("sources"), F.lit(now).cast("bigint").alias("timestamp")
    )
