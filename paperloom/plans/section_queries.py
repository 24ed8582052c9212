"""Queries over pages, section leaves, scores and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import retrieval as R
from paperloom.operators import sections as S
from paperloom.sources import read_table

from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.add

# The five heading forms of functions.text in the SQL of DuckDB.
HEADING = " OR ".join(
    f"regexp_matches(text, '{p}')"
    for p in (
        r"(?m)^(\d+\.?\d*\.?\s+)[A-Z][a-zA-Z\s]{2,}$",
        r"(?m)^[A-Z][A-Z\s]{3,30}$",
        r"(?im)^(Abstract|Introduction|Methods?|Results?|Discussion|Conclusion|References|Acknowledgements?|Appendix)$",
        r"(?m)^第[一二三四五六七八九十\d]+[章节]",
        r"(?m)^\d+(?:\.\d+)*[\s]+[一-龥]{2,10}$",
    )
)
PAGES = "pages AS (SELECT paper_id, page_no, max(coalesce(text, '')) AS text FROM paper_pages WHERE paper_id IS NOT NULL AND page_no IS NOT NULL GROUP BY paper_id, page_no)"
CHUNKS = """chunks AS (SELECT paper_id, unnest(range(0, last + 1, 5)) AS start_page, last FROM (SELECT paper_id, max(page_no) AS last FROM pages GROUP BY paper_id)),
fixed AS (SELECT paper_id, CAST(start_page AS INTEGER) AS start_page, CAST(least(start_page + 4, last) AS INTEGER) AS end_page FROM chunks)"""
RANGES = f"""marked AS (SELECT paper_id, page_no, ({HEADING}) AS heading FROM pages),
semantic AS (SELECT paper_id, max(page_no) AS last FROM marked GROUP BY paper_id HAVING count(*) FILTER (heading) >= 2),
starts AS (SELECT m.paper_id, m.page_no AS start_page, s.last FROM marked m JOIN semantic s USING (paper_id) WHERE m.heading UNION SELECT paper_id, 0, last FROM semantic),
ranges AS (SELECT paper_id, start_page, coalesce(lead(start_page) OVER (PARTITION BY paper_id ORDER BY start_page) - 1, last) AS end_page FROM starts)"""
MERGED = """opened AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR (start_page - first_value(start_page) OVER w >= 2 AND end_page - start_page + 1 >= 2) THEN 1 ELSE 0 END AS opens FROM ranges WINDOW w AS (PARTITION BY paper_id ORDER BY start_page)),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY paper_id ORDER BY start_page) AS g FROM opened),
merged AS (SELECT paper_id, min(start_page) AS start_page, max(end_page) AS end_page, true AS semantic FROM grouped GROUP BY paper_id, g),
every_range AS (SELECT paper_id, start_page, end_page, semantic FROM merged UNION ALL SELECT paper_id, start_page, end_page, false FROM fixed WHERE paper_id NOT IN (SELECT paper_id FROM merged)),
leaves AS (SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY start_page) - 1 AS INTEGER) AS leaf_no, start_page, end_page, semantic FROM every_range)"""
ALL_LEAVES = f"WITH {PAGES}, {CHUNKS}, {RANGES}, {MERGED}"
STORED = """stored AS (SELECT paper_id, leaf_no, max(title) AS title, max(summary) AS summary, min(start_page) AS start_page, max(end_page) AS end_page FROM section_leaves WHERE paper_id IS NOT NULL GROUP BY paper_id, leaf_no)"""


def stored_leaves(spark: SparkSession, d: str) -> DataFrame:
    """One row per stored leaf."""
    leaves = read_table(spark, d, "section_leaves").where("paper_id is not null")
    return leaves.groupBy("paper_id", "leaf_no").agg(F.max("title").alias("title"), F.max("summary").alias("summary"), F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"))


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "paper_pages")


@query("q_heading_pages", f"WITH {PAGES} SELECT paper_id, page_no FROM pages WHERE {HEADING}")
def q_heading_pages(spark: SparkSession, d: str) -> DataFrame:
    return S.heading_pages(pages_of(spark, d))


@query("q_fixed_chunks", f"WITH {PAGES}, {CHUNKS} SELECT * FROM fixed")
def q_fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return S.chunk_ranges(pages_of(spark, d))


@query("q_section_ranges", f"WITH {PAGES}, {RANGES} SELECT * FROM ranges")
def q_section_ranges(spark: SparkSession, d: str) -> DataFrame:
    return S.heading_ranges(pages_of(spark, d))


@query("q_section_leaves", f"{ALL_LEAVES} SELECT * FROM leaves")
def q_section_leaves(spark: SparkSession, d: str) -> DataFrame:
    return S.leaf_ranges(pages_of(spark, d))


@query(
    "q_leaf_prompts",
    f"""{ALL_LEAVES}, texts AS (SELECT l.paper_id, l.leaf_no, string_agg(p.text, E'\\n\\n' ORDER BY p.page_no) AS text FROM leaves l JOIN pages p ON p.paper_id = l.paper_id AND p.page_no BETWEEN l.start_page AND l.end_page GROUP BY l.paper_id, l.leaf_no)
        SELECT paper_id, leaf_no, label, 'Describe these pages of a paper (' || label || E').\\n' || substring(coalesce(text, ''), 1, 3000) || E'\\nAnswer with a JSON object holding title and summary.' AS prompt
        FROM (SELECT paper_id, leaf_no, 'Pages ' || (start_page + 1) || '–' || (end_page + 1) AS label, text FROM leaves LEFT JOIN texts USING (paper_id, leaf_no))""",
)
def q_leaf_prompts(spark: SparkSession, d: str) -> DataFrame:
    return S.leaf_prompts(S.leaf_ranges(pages_of(spark, d)), pages_of(spark, d))


@query("q_leaf_labels", f"WITH {STORED} SELECT paper_id, leaf_no, 'Pages ' || (start_page + 1) || '–' || (end_page + 1) || ': ' || coalesce(title, '') AS label FROM stored")
def q_leaf_labels(spark: SparkSession, d: str) -> DataFrame:
    return stored_leaves(spark, d).select("paper_id", "leaf_no", T.source_label(F.col("start_page"), F.col("end_page"), F.col("title")).alias("label"))


# Replies of a rating model, made from the stored leaves: plain, fenced, broken, empty and with an unknown id.
REPLIES = f"""{STORED}, listed AS (SELECT paper_id, '[' || string_agg('{{"id":' || leaf_no || ',"score":' || ((leaf_no * 7 + length(coalesce(title, ''))) % 11) || '}}', ',' ORDER BY leaf_no) || ']' AS j FROM stored GROUP BY paper_id),
replies AS (SELECT paper_id, CASE ascii(substring(paper_id, 1, 1)) % 6 WHEN 0 THEN E'```json\\n' || j || E'\\n```' WHEN 1 THEN 'no scores today' WHEN 2 THEN '[]' WHEN 3 THEN '[{{"id":99,"score":9}}]' ELSE j END AS reply FROM listed)"""
SCORES = r"""clean AS (SELECT paper_id, trim(regexp_replace(reply, '```json\n?|```', '', 'g'), E' \t\n\r') AS j FROM replies),
scores AS (SELECT paper_id, CAST(pos - 1 AS INTEGER) AS pos, CAST(json_extract_string(j, '$[' || (pos - 1) || '].id') AS INTEGER) AS id, CAST(json_extract_string(j, '$[' || (pos - 1) || '].score') AS DOUBLE) AS score
FROM (SELECT paper_id, j, unnest(range(1, CAST(json_array_length(j) AS BIGINT) + 1)) AS pos FROM clean WHERE regexp_matches(j, '^\[(?s:.*)\]$')))"""
SELECTED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC NULLS LAST, pos) AS rnk FROM scores),
picked AS (SELECT * FROM ranked WHERE rnk = 1 OR (rnk = 2 AND score >= 4)),
sizes AS (SELECT paper_id, count(*) AS n FROM stored GROUP BY paper_id),
wanted AS (SELECT z.paper_id, CASE WHEN n = 1 OR rnk IS NULL THEN 0 ELSE id END AS leaf_no, CASE WHEN n = 1 THEN 'single' WHEN rnk IS NULL THEN 'fallback' ELSE 'scored' END AS status, CAST(coalesce(rnk, 1) AS INTEGER) AS rank
FROM sizes z LEFT JOIN picked p ON p.paper_id = z.paper_id WHERE n > 1 OR rnk IS NULL OR rnk = 1),
selected AS (SELECT w.paper_id, w.leaf_no, w.rank, s.start_page, s.end_page, s.title, CASE WHEN s.leaf_no IS NULL THEN 'invalid_id' ELSE w.status END AS selection_status FROM wanted w LEFT JOIN stored s ON s.paper_id = w.paper_id AND s.leaf_no = w.leaf_no)"""
CONTEXT = rf"""{PAGES}, once AS (SELECT * FROM selected WHERE selection_status <> 'invalid_id'),
texts AS (SELECT o.paper_id, o.leaf_no, o.rank, string_agg(p.text, E'\n\n' ORDER BY p.page_no) AS text FROM once o JOIN pages p ON p.paper_id = o.paper_id AND p.page_no BETWEEN o.start_page AND o.end_page GROUP BY ALL),
contexts AS (SELECT o.paper_id, string_agg(coalesce(t.text, ''), E'\n\n---\n\n' ORDER BY o.start_page, o.rank) AS context, string_agg('Pages ' || (o.start_page + 1) || '–' || (o.end_page + 1) || ': ' || coalesce(o.title, ''), ' | ' ORDER BY o.start_page, o.rank) AS sources, count(*) AS n_selected
FROM once o LEFT JOIN texts t ON t.paper_id = o.paper_id AND t.leaf_no = o.leaf_no AND t.rank = o.rank GROUP BY o.paper_id)"""


def replies(spark: SparkSession, d: str) -> DataFrame:
    entry = F.concat(F.lit('{"id":'), F.col("leaf_no").cast("string"), F.lit(',"score":'), ((F.col("leaf_no") * 7 + F.length(F.coalesce("title", F.lit("")))) % 11).cast("string"), F.lit("}"))
    listed = stored_leaves(spark, d).withColumn("entry", entry).groupBy("paper_id").agg(F.concat(F.lit("["), T.ordered_join(["leaf_no"], "entry", ","), F.lit("]")).alias("j"))
    kind = F.ascii(F.substring("paper_id", 1, 1)) % 6
    reply = F.when(kind == 0, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).when(kind == 1, "no scores today").when(kind == 2, "[]").when(kind == 3, '[{"id":99,"score":9}]').otherwise(F.col("j"))
    return listed.select("paper_id", reply.alias("reply"))


def selected(spark: SparkSession, d: str) -> DataFrame:
    return R.selected_leaves(R.score_rows(replies(spark, d), ["paper_id"]), stored_leaves(spark, d), ["paper_id"])


@query("q_score_parse", f"WITH {REPLIES}, {SCORES} SELECT * FROM scores")
def q_score_parse(spark: SparkSession, d: str) -> DataFrame:
    return R.score_rows(replies(spark, d), ["paper_id"])


@query("q_top2_select", f"WITH {REPLIES}, {SCORES}, {SELECTED} SELECT * FROM selected")
def q_top2_select(spark: SparkSession, d: str) -> DataFrame:
    return selected(spark, d)


@query("q_select_fallback", f"WITH {REPLIES}, {SCORES}, {SELECTED} SELECT selection_status, count(*) AS n FROM selected GROUP BY selection_status")
def q_select_fallback(spark: SparkSession, d: str) -> DataFrame:
    return selected(spark, d).groupBy("selection_status").agg(F.count("*").alias("n"))


@query("q_context_assembly", f"WITH {REPLIES}, {SCORES}, {SELECTED}, {CONTEXT} SELECT * FROM contexts")
def q_context_assembly(spark: SparkSession, d: str) -> DataFrame:
    return R.paper_contexts(selected(spark, d), pages_of(spark, d))


CONVERSATION = """named AS (SELECT id AS conversation_id, unnest(paper_ids) AS paper_id, generate_subscripts(paper_ids, 1) AS pos FROM (SELECT DISTINCT id, paper_ids FROM conversations)),
per_conversation AS (SELECT conversation_id, count(*) AS papers, string_agg(context, E'\\n\\n---\\n\\n' ORDER BY pos, paper_id) AS context, string_agg(sources, ' | ' ORDER BY pos, paper_id) AS sources FROM named JOIN contexts USING (paper_id) GROUP BY conversation_id)"""


@query("q_conv_context", f"WITH {REPLIES}, {SCORES}, {SELECTED}, {CONTEXT}, {CONVERSATION} SELECT * FROM per_conversation")
def q_conv_context(spark: SparkSession, d: str) -> DataFrame:
    return R.conversation_contexts(read_table(spark, d, "conversations"), R.paper_contexts(selected(spark, d), pages_of(spark, d)))


@query(
    "q_manual_context",
    f"""WITH {REPLIES}, {SCORES}, {SELECTED}, {CONTEXT}, {CONVERSATION}, titled AS (SELECT DISTINCT id, title FROM conversations),
        finals AS (SELECT t.id, t.title, CASE WHEN ascii(substring(t.id, 1, 1)) % 3 = 0 AND trim(coalesce(t.title, '')) <> '' THEN t.title ELSE coalesce(p.context, '') END AS context FROM titled t LEFT JOIN per_conversation p ON p.conversation_id = t.id)
        SELECT id, length('You help.' || E'\\n\\n' || 'Write formulas between dollar signs.' || CASE WHEN context <> '' THEN E'\\n\\nReference material:\\n' || context ELSE '' END) AS system_length, md5(context) AS context_md5 FROM finals""",
)
def q_manual_context(spark: SparkSession, d: str) -> DataFrame:
    """Titles stand for snippets picked by hand in a third of the conversations."""
    contexts = R.conversation_contexts(read_table(spark, d, "conversations"), R.paper_contexts(selected(spark, d), pages_of(spark, d)))
    titled = read_table(spark, d, "conversations").select("id", "title").distinct()
    manual = F.when(F.ascii(F.substring("id", 1, 1)) % 3 == 0, F.col("title"))
    out = titled.join(contexts, titled.id == contexts.conversation_id, "left").withColumn("final", R.final_context(manual, F.col("context")))
    return out.select("id", F.length(R.system_message(F.lit("You help."), F.col("final"))).cast("bigint").alias("system_length"), F.md5("final").alias("context_md5"))


@query("q_answer_pipeline")
def q_answer_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return R.answers(read_table(spark, d, "conversations"), read_table(spark, d, "messages"), stored_leaves(spark, d), pages_of(spark, d))
