"""Queries over the library catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import library as L
from paperloom.operators.hot import ranked
from paperloom.sources import read_table

from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.add


def joined(column: str) -> F.Column:
    return F.coalesce(F.array_join(column, "|"), F.lit("")).alias(f"{column}_text")


@query("q_kb_list", "SELECT id, name, description, color, created_at, row_number() OVER (ORDER BY created_at, id) AS position FROM knowledge_bases")
def q_kb_list(spark: SparkSession, d: str) -> DataFrame:
    return L.listed_collections(read_table(spark, d, "knowledge_bases"))


@query(
    "q_paper_list",
    """SELECT id, knowledge_base_id, title, coalesce(array_to_string(authors, '|'), '') AS authors_text, coalesce(array_to_string(tags, '|'), '') AS tags_text, status, file_name, added_at,
       row_number() OVER (PARTITION BY knowledge_base_id ORDER BY added_at DESC, id, status, title NULLS FIRST) AS position FROM papers""",
)
def q_paper_list(spark: SparkSession, d: str) -> DataFrame:
    papers = read_table(spark, d, "papers").select("id", "knowledge_base_id", "title", joined("authors"), joined("tags"), "status", "file_name", "added_at", (-F.col("added_at")).alias("age"))
    return ranked(papers, "knowledge_base_id", "age", [F.col("age"), F.col("id"), F.col("status"), F.col("title")], "position").drop("age")


@query(
    "q_highlights_by_paper",
    """SELECT id, paper_id, text, page_num, color, note, created_at, row_number() OVER (PARTITION BY paper_id ORDER BY created_at, id) AS position FROM (
       SELECT DISTINCT paper_id || '#' || leaf_no AS id, paper_id, title AS text, start_page AS page_num, '#c9a84c' AS color, '' AS note, CAST(leaf_no AS BIGINT) AS created_at FROM section_leaves WHERE paper_id IS NOT NULL)""",
)
def q_highlights_by_paper(spark: SparkSession, d: str) -> DataFrame:
    """Section titles stand for marked passages, of which the test data has none."""
    from pyspark.sql import Window

    leaves = read_table(spark, d, "section_leaves").where("paper_id is not null")
    marks = leaves.select(F.concat("paper_id", F.lit("#"), F.col("leaf_no").cast("string")).alias("id"), "paper_id", F.col("title").alias("text"), F.col("start_page").alias("page_num"), F.lit("#c9a84c").alias("color"), F.lit("").alias("note"), F.col("leaf_no").cast("bigint").alias("created_at")).distinct()
    return marks.withColumn("position", F.row_number().over(Window.partitionBy("paper_id").orderBy("created_at", "id")))


@query("q_kb_paper_counts", "SELECT k.id, k.name, count(p.id) AS papers FROM knowledge_bases k LEFT JOIN papers p ON p.knowledge_base_id = k.id GROUP BY k.id, k.name")
def q_kb_paper_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.collection_counts(read_table(spark, d, "knowledge_bases"), read_table(spark, d, "papers"))


@query("q_kb_count_total", "SELECT (SELECT count(*) FROM knowledge_bases) AS collections, (SELECT count(*) FROM papers) AS papers, (SELECT count(*) FROM knowledge_bases) = 0 AS needs_seed")
def q_kb_count_total(spark: SparkSession, d: str) -> DataFrame:
    kbs = read_table(spark, d, "knowledge_bases").agg(F.count("*").alias("collections"))
    papers = read_table(spark, d, "papers").agg(F.count("*").alias("papers"))
    return kbs.join(papers, F.lit(True)).withColumn("needs_seed", F.col("collections") == 0)


@query("q_kb_successor", "SELECT id, coalesce(lead(id) OVER w, first_value(id) OVER w) AS next_id FROM knowledge_bases WINDOW w AS (ORDER BY created_at, id)")
def q_kb_successor(spark: SparkSession, d: str) -> DataFrame:
    return L.collection_successor(read_table(spark, d, "knowledge_bases"))


@query("q_kb_deletable", "SELECT id, name FROM knowledge_bases WHERE id <> 'default'")
def q_kb_deletable(spark: SparkSession, d: str) -> DataFrame:
    return L.deletable(read_table(spark, d, "knowledge_bases")).select("id", "name")


@query("q_paper_lookup", "SELECT id, title, coalesce(array_to_string(authors, '|'), '') AS authors_text, abstract, year, status FROM papers WHERE id = (SELECT min(id) FROM papers)")
def q_paper_lookup(spark: SparkSession, d: str) -> DataFrame:
    papers = read_table(spark, d, "papers")
    wanted = papers.agg(F.min("id").alias("wanted"))
    return papers.join(F.broadcast(wanted), papers.id == wanted.wanted, "left_semi").select("id", "title", joined("authors"), "abstract", "year", "status")  # one row is sent


@query("q_papers_by_kb", "SELECT id, title, status, added_at FROM papers WHERE knowledge_base_id = 'default'")
def q_papers_by_kb(spark: SparkSession, d: str) -> DataFrame:
    return L.papers_in(read_table(spark, d, "papers"), "default").select("id", "title", "status", "added_at")


@query(
    "q_paper_cards",
    """SELECT id, coalesce(nullif(title, ''), file_name) AS display_title, coalesce(nullif(array_to_string(authors, ', '), ''), 'Unknown authors') AS display_authors,
       coalesce(authors[1], 'Unknown') AS first_author, coalesce(CAST(nullif(year, 0) AS VARCHAR), '—') AS display_year,
       substring(coalesce(abstract, ''), 1, 120) || CASE WHEN length(coalesce(abstract, '')) > 120 THEN '…' ELSE '' END AS preview, array_to_string(tags[1:2], ', ') AS shown_tags,
       CASE status WHEN 'unread' THEN 'Unread' WHEN 'reading' THEN 'Reading' WHEN 'done' THEN 'Done' ELSE status END AS status_label, CASE WHEN status = 'unread' THEN 'reading' ELSE status END AS status_after_opening FROM papers""",
)
def q_paper_cards(spark: SparkSession, d: str) -> DataFrame:
    return L.cards(read_table(spark, d, "papers"))


@query("q_indexed_papers", "SELECT DISTINCT paper_id AS id FROM section_leaves WHERE paper_id IS NOT NULL")
def q_indexed_papers(spark: SparkSession, d: str) -> DataFrame:
    return L.indexed_ids(read_table(spark, d, "section_leaves"))


@query("q_unindexed_papers", "SELECT DISTINCT id FROM papers p WHERE NOT EXISTS (SELECT 1 FROM section_leaves s WHERE s.paper_id = p.id)")
def q_unindexed_papers(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.operators.sections import missing_index

    return missing_index(read_table(spark, d, "papers"), read_table(spark, d, "section_leaves"))


@query("q_index_badges", "SELECT p.id, CASE WHEN EXISTS (SELECT 1 FROM section_leaves s WHERE s.paper_id = p.id) THEN 'indexed' ELSE 'none' END AS badge FROM papers p")
def q_index_badges(spark: SparkSession, d: str) -> DataFrame:
    return L.badges(read_table(spark, d, "papers"), read_table(spark, d, "section_leaves"))


@query("q_selected_papers", "SELECT id, title FROM papers p WHERE EXISTS (SELECT 1 FROM (SELECT unnest(paper_ids) AS pid FROM conversations) c WHERE c.pid = p.id)")
def q_selected_papers(spark: SparkSession, d: str) -> DataFrame:
    chosen = read_table(spark, d, "conversations").select(F.explode("paper_ids").alias("id")).distinct()
    return read_table(spark, d, "papers").join(chosen, "id", "left_semi").select("id", "title")


@query(
    "q_toggle_selection",
    """SELECT id, array_to_string(CASE WHEN list_contains(paper_ids, x) THEN list_filter(paper_ids, lambda p: p <> x) ELSE list_append(paper_ids, x) END, '|') AS toggled, len(paper_ids) AS selected
       FROM conversations, (SELECT min(id) AS x FROM papers) t WHERE paper_ids IS NOT NULL""",
)
def q_toggle_selection(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, "papers").agg(F.min("id").alias("x"))
    convs = read_table(spark, d, "conversations").where("paper_ids is not null").join(F.broadcast(x), F.lit(True))  # one row is sent
    return convs.select("id", F.array_join(L.toggled("paper_ids", F.col("x")), "|").alias("toggled"), F.size("paper_ids").cast("bigint").alias("selected"))


@query(
    "q_import_progress",
    """WITH items AS (SELECT knowledge_base_id, CASE lower(status) WHEN 'done' THEN 'done' WHEN 'archived' THEN 'error' WHEN 'reading' THEN 'parsing' ELSE 'pending' END AS status FROM papers)
       SELECT knowledge_base_id, count(*) AS items, count(*) FILTER (status IN ('done', 'error')) AS ended, bool_or(status = 'error') AS any_error,
       count(*) = count(*) FILTER (status IN ('done', 'error')) AS all_ended, CAST(floor(count(*) FILTER (status IN ('done', 'error')) * 100.0 / count(*) + 0.5) AS BIGINT) AS percent FROM items GROUP BY knowledge_base_id""",
)
def q_import_progress(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("status")
    stage = F.when(low == "done", "done").when(low == "archived", "error").when(low == "reading", "parsing").otherwise("pending")
    return L.import_progress(read_table(spark, d, "papers").select("knowledge_base_id", stage.alias("status")), "knowledge_base_id")


@query("q_meta_title", "SELECT id, coalesce(nullif(title, ''), regexp_replace(file_name, '\\.pdf$', '', 'i')) AS title_found FROM papers")
def q_meta_title(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "papers").select("id", T.title_of(F.col("title"), F.col("file_name")).alias("title_found"))


@query(
    "q_meta_authors",
    """SELECT id, array_to_string(list_filter(list_transform(string_split_regex(coalesce(array_to_string(authors, '; '), ''), '[,;]+'), lambda x: trim(x, E' \\t\\n\\r')), lambda x: x <> ''), '|') AS authors_found FROM papers""",
)
def q_meta_authors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "papers").select("id", F.array_join(T.split_authors(F.array_join("authors", "; ")), "|").alias("authors_found"))


@query("q_meta_abstract", "SELECT paper_id, page_no, trim(regexp_extract(coalesce('Abstract: ' || text, ''), '(?i)abstract[:\\s]+(.{100,600})', 1), E' \\t\\n\\r') AS abstract_found FROM paper_pages")
def q_meta_abstract(spark: SparkSession, d: str) -> DataFrame:
    """Every page is read as one that opens with its abstract; the pages of the test data hold no such word."""
    return read_table(spark, d, "paper_pages").select("paper_id", "page_no", T.abstract_of(F.concat(F.lit("Abstract: "), "text")).alias("abstract_found"))


@query("q_meta_year", "SELECT id, coalesce(TRY_CAST(regexp_extract(coalesce(abstract, '') || ' (' || coalesce(year, 0) || ')', '\\b((?:19|20)\\d{2})\\b', 1) AS INTEGER), 0) AS year_found FROM papers")
def q_meta_year(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.coalesce("abstract", F.lit("")), F.lit(" ("), F.coalesce("year", F.lit(0)).cast("string"), F.lit(")"))
    return read_table(spark, d, "papers").select("id", T.year_of(text).alias("year_found"))


@query("q_export_bundle", " UNION ALL ".join(f"SELECT '{t}' AS section, count(*) AS rows FROM {t}" for t in ("knowledge_bases", "papers", "conversations", "messages")))
def q_export_bundle(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.sources.export import bundle, bundle_counts

    return bundle_counts(bundle({t: read_table(spark, d, t) for t in ("knowledge_bases", "papers", "conversations", "messages")}))
