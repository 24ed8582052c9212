"""Further lookups, lists and changes of the library, and the index and prompts built with the offline stand-in for a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import conversation as C
from paperloom.operators import library as L
from paperloom.operators import mutate as M
from paperloom.operators import retrieval as R
from paperloom.operators import sections as S
from paperloom.operators import settings as P
from paperloom.sources import export, read_table

from .change_queries import HIT, highlights, hit, settings
from .registry import Registry
from .section_queries import ALL_LEAVES, STORED, pages_of, stored_leaves

REGISTRY = Registry()
query = REGISTRY.add


def least_id(spark: SparkSession, d: str, table: str = "papers", column: str = "id") -> DataFrame:
    """One row."""
    return F.broadcast(read_table(spark, d, table).agg(F.min(column).alias("x")))


@query("q_paper_list_all", "SELECT id, added_at, row_number() OVER (ORDER BY added_at DESC NULLS LAST, id, status, title NULLS FIRST) AS position FROM papers")
def q_paper_list_all(spark: SparkSession, d: str) -> DataFrame:
    out = L.newest_first(read_table(spark, d, "papers"), "added_at", [F.col("id"), F.col("status"), F.col("title")])
    return out.select("id", "added_at", F.col("position").cast("bigint").alias("position"))


@query("q_conv_list", "SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id, title NULLS FIRST) AS position FROM conversations")
def q_conv_list(spark: SparkSession, d: str) -> DataFrame:
    out = L.newest_first(read_table(spark, d, "conversations"), "created_at", [F.col("id"), F.col("title")])
    return out.select("id", "created_at", F.col("position").cast("bigint").alias("position"))


@query(
    "q_first_of_lists",
    """SELECT 'collection' AS kind, 'all' AS of, (SELECT id FROM knowledge_bases ORDER BY created_at, id LIMIT 1) AS id UNION ALL
       SELECT 'conversation', paper_id, id FROM (SELECT paper_id, id, row_number() OVER (PARTITION BY paper_id ORDER BY created_at DESC NULLS LAST, id) AS n FROM (SELECT id, created_at, unnest(paper_ids) AS paper_id FROM conversations)) WHERE n = 1""",
)
def q_first_of_lists(spark: SparkSession, d: str) -> DataFrame:
    """What a list shows when nothing was chosen: the first collection, and for each paper its newest conversation."""
    first = read_table(spark, d, "knowledge_bases").agg(F.min(F.struct("created_at", "id"))["id"].alias("id")).select(F.lit("collection").alias("kind"), F.lit("all").alias("of"), "id")
    return first.unionByName(C.newest_per_paper(read_table(spark, d, "conversations")).select(F.lit("conversation").alias("kind"), F.col("paper_id").alias("of"), "id"))


@query("q_convs_with_paper", "SELECT id, created_at FROM conversations WHERE list_contains(paper_ids, (SELECT min(p) FROM (SELECT unnest(paper_ids) AS p FROM conversations)))")
def q_convs_with_paper(spark: SparkSession, d: str) -> DataFrame:
    convs = read_table(spark, d, "conversations")
    asked = F.broadcast(convs.select(F.explode("paper_ids").alias("p")).agg(F.min("p").alias("x")))  # one row is sent
    return C.containing(convs.join(asked, F.lit(True)), F.col("x")).select("id", "created_at")


@query(
    "q_index_lookup",
    "WITH x AS (SELECT min(paper_id) AS x FROM section_leaves) SELECT 'leaf' AS kind, leaf_no AS no, title AS text FROM section_leaves, x WHERE paper_id = x UNION ALL SELECT 'page', page_no, text FROM paper_pages, x WHERE paper_id = x",
)
def q_index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Leaves and pages of one paper."""
    asked = least_id(spark, d, "section_leaves", "paper_id")
    of = lambda table: read_table(spark, d, table).join(asked, F.col("paper_id") == F.col("x"))
    return of("section_leaves").select(F.lit("leaf").alias("kind"), F.col("leaf_no").alias("no"), F.col("title").alias("text")).unionByName(of("paper_pages").select(F.lit("page").alias("kind"), F.col("page_no").alias("no"), "text"))


@query("q_setting_decoded", "SELECT * FROM (VALUES ('theme', 'dark'), ('zoom', '1.5')) v(key, value)")
def q_setting_decoded(spark: SparkSession, d: str) -> DataFrame:
    known = settings(spark, ("zoom", "1.5"))
    out = None
    for key in ("theme", "zoom", "nothing"):
        one = P.decoded(known, key).select(F.lit(key).alias("key"), "value")
        out = one if out is None else out.unionByName(one)
    return out


@query("q_selection_union", "SELECT id, array_to_string(list_sort(list_distinct(list_append(coalesce(paper_ids, []), x))), '|') AS ids FROM conversations, (SELECT min(id) AS x FROM papers) t")
def q_selection_union(spark: SparkSession, d: str) -> DataFrame:
    convs = read_table(spark, d, "conversations").join(least_id(spark, d), F.lit(True))
    return convs.select("id", F.array_join(F.array_sort(L.added_to("paper_ids", F.col("x"))), "|").alias("ids"))


@query("q_index_states", f"SELECT p.id, CASE WHEN EXISTS (SELECT 1 FROM section_leaves s WHERE s.paper_id = p.id) THEN 'indexed' WHEN {HIT} THEN 'indexing' ELSE 'none' END AS badge FROM papers p")
def q_index_states(spark: SparkSession, d: str) -> DataFrame:
    """Papers whose ids begin with certain characters are in work."""
    papers = read_table(spark, d, "papers")
    return L.badges(papers, read_table(spark, d, "section_leaves"), papers.where(hit()).select("id"))


@query("q_index_todo", f"SELECT DISTINCT id FROM papers p WHERE NOT EXISTS (SELECT 1 FROM section_leaves s WHERE s.paper_id = p.id) AND NOT ({HIT})")
def q_index_todo(spark: SparkSession, d: str) -> DataFrame:
    """Papers without an index that nobody is building."""
    papers = read_table(spark, d, "papers")
    return S.missing_index(papers, read_table(spark, d, "section_leaves"), papers.where(hit()).select("id"))


@query(
    "q_kb_after",
    """WITH listed AS (SELECT id, lead(id) OVER (ORDER BY created_at, id) AS after FROM knowledge_bases), first AS (SELECT id FROM knowledge_bases ORDER BY created_at, id LIMIT 1),
       asked AS (SELECT id AS request, id AS kb_id FROM knowledge_bases UNION ALL SELECT 'gone', 'no-such-collection') SELECT request, coalesce(after, (SELECT id FROM first)) AS next_id FROM asked LEFT JOIN listed ON listed.id = asked.kb_id""",
)
def q_kb_after(spark: SparkSession, d: str) -> DataFrame:
    kbs = read_table(spark, d, "knowledge_bases")
    asked = kbs.select(F.col("id").alias("request"), F.col("id").alias("kb_id")).unionByName(spark.createDataFrame([("gone", "no-such-collection")], "request string, kb_id string"))
    return L.successor_of(asked, kbs)


@query(
    "q_import_stages",
    """WITH items AS (SELECT id, CASE lower(status) WHEN 'done' THEN 'done' WHEN 'archived' THEN 'error' WHEN 'reading' THEN 'parsing' WHEN 'unread' THEN 'saving' ELSE 'pending' END AS status FROM papers)
       SELECT id, CASE status WHEN 'pending' THEN 'Waiting' WHEN 'parsing' THEN 'Reading the file' WHEN 'saving' THEN 'Saving' WHEN 'done' THEN 'Done' ELSE 'Failed' END AS label,
       CASE WHEN status IN ('done', 'error') THEN status WHEN substring(id, 1, 1) IN ('0', '1', '2') THEN 'error' WHEN status = 'pending' THEN 'parsing' WHEN status = 'parsing' THEN 'saving' ELSE 'done' END AS next FROM items""",
)
def q_import_stages(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("status")
    stage = F.when(low == "done", "done").when(low == "archived", "error").when(low == "reading", "parsing").when(low == "unread", "saving").otherwise("pending")
    return read_table(spark, d, "papers").select("id", L.stage_label(stage).alias("label"), L.advanced(stage, hit()).alias("next"))


@query(
    "q_highlight_insert",
    """WITH marks AS (SELECT DISTINCT paper_id || '#' || leaf_no AS id, paper_id FROM section_leaves WHERE paper_id IS NOT NULL), new AS (SELECT DISTINCT 'new-' || id AS id, id AS paper_id FROM papers UNION ALL SELECT 'orphan', 'no-such-paper')
       SELECT id, paper_id FROM marks UNION ALL SELECT id, paper_id FROM new WHERE paper_id IN (SELECT id FROM papers)""",
)
def q_highlight_insert(spark: SparkSession, d: str) -> DataFrame:
    papers = read_table(spark, d, "papers")
    new = papers.select(F.concat(F.lit("new-"), "id").alias("id"), F.col("id").alias("paper_id")).distinct().unionByName(spark.createDataFrame([("orphan", "no-such-paper")], "id string, paper_id string"))
    return M.inserted(highlights(spark, d), new, "id", papers, "paper_id")


@query(
    "q_paper_insert",
    """WITH new AS (SELECT 'new-' || id AS id, id AS knowledge_base_id FROM knowledge_bases UNION ALL SELECT 'orphan', 'no-such-collection')
       SELECT id, knowledge_base_id, file_name FROM papers UNION ALL SELECT id, knowledge_base_id, id || '.pdf' FROM new WHERE knowledge_base_id IN (SELECT id FROM knowledge_bases)""",
)
def q_paper_insert(spark: SparkSession, d: str) -> DataFrame:
    """New papers arrive with the bytes of their file, which are not stored in the table."""
    papers, kbs = read_table(spark, d, "papers"), read_table(spark, d, "knowledge_bases")
    ids = kbs.select(F.concat(F.lit("new-"), "id").alias("id"), F.col("id").alias("knowledge_base_id")).unionByName(spark.createDataFrame([("orphan", "no-such-collection")], "id string, knowledge_base_id string"))
    rest = {c: F.lit(None).cast(papers.schema[c].dataType).alias(c) for c in papers.columns}
    rows = ids.select("id", "knowledge_base_id", *(F.concat("id", F.lit(".pdf")).alias(c) if c == "file_name" else rest[c] for c in papers.columns if c not in ("id", "knowledge_base_id")), F.lit("bytes").alias("file_data"))
    return M.papers_added(papers, rows, kbs).select("id", "knowledge_base_id", "file_name")


PARTS = ("paper_pages", "section_roots", "section_leaves")


@query(
    "q_paper_delete_keys",
    f"""WITH gone AS (SELECT id FROM papers WHERE {HIT}), marks AS (SELECT DISTINCT paper_id || '#' || leaf_no AS id, paper_id FROM section_leaves WHERE paper_id IS NOT NULL)
        SELECT 'papers' AS table_name, id AS key, count(*) AS rows FROM papers WHERE NOT ({HIT}) GROUP BY id UNION ALL SELECT 'highlights', id, count(*) FROM marks WHERE paper_id NOT IN (SELECT id FROM gone) GROUP BY id"""
    + "".join(f" UNION ALL SELECT '{t}', paper_id, count(*) FROM {t} WHERE paper_id IS NULL OR paper_id NOT IN (SELECT id FROM gone) GROUP BY paper_id" for t in PARTS),
)
def q_paper_delete_keys(spark: SparkSession, d: str) -> DataFrame:
    """What stays after the removal of papers, key by key, highlights among the children."""
    papers = read_table(spark, d, "papers")
    children = {"highlights": highlights(spark, d)} | {t: read_table(spark, d, t) for t in PARTS}
    out = None
    for name, df in M.papers_removed(papers.where(hit()).select("id"), papers, children).items():
        one = df.groupBy(F.col("id" if name in ("papers", "highlights") else "paper_id").alias("key")).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "key", "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("q_profile_repoint", "SELECT * FROM (VALUES ('chat', 'p1'), ('index', 'p1'), ('rewrite', 'p1')) v(name, profile_id)")
def q_profile_repoint(spark: SparkSession, d: str) -> DataFrame:
    """The profile that a selection names is removed; a selection of one that never was moves too."""
    chosen = spark.createDataFrame([("chat", "p2"), ("index", "p1"), ("rewrite", None)], "name string, profile_id string")
    return P.repointed(chosen, P.profile_removed(P.profiles(settings(spark)), "p2"))


def _json_sql(table: str, *columns: str) -> str:
    return f"SELECT '{table}' AS section, CAST(json_merge_patch('{{}}', to_json({{{', '.join(f'{c}: {c}' for c in columns)}}})) AS VARCHAR) AS row FROM {table}"


@query(
    "q_export_rows",
    _json_sql("knowledge_bases", "id", "name", "description", "color", "created_at") + " UNION ALL " + _json_sql("papers", "id", "knowledge_base_id", "title", "authors", "abstract", "year", "tags", "status", "file_name", "file_path", "added_at") + " UNION ALL " + _json_sql("conversations", "id", "title", "paper_ids", "created_at"),
)
def q_export_rows(spark: SparkSession, d: str) -> DataFrame:
    """The JSON lines of a backup themselves."""
    return export.bundle({t: read_table(spark, d, t) for t in ("knowledge_bases", "papers", "conversations")})


@query("q_backup_name", "SELECT id, 'paperloom-backup-' || created_at || '.json' AS file_name FROM conversations WHERE created_at IS NOT NULL")
def q_backup_name(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "conversations").where("created_at is not null").select("id", export.backup_name(F.col("created_at")).alias("file_name"))


@query("q_stamped", "SELECT count(*) AS rows, count(*) AS ids, true AS timely FROM papers")
def q_stamped(spark: SparkSession, d: str) -> DataFrame:
    """Fresh ids are distinct and times are present ones."""
    fresh = M.stamped(read_table(spark, d, "papers").select("title"), "added_at")
    return fresh.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.coalesce(F.bool_and(F.col("added_at") > 1_700_000_000_000), F.lit(True)).alias("timely"))


@query("q_seed_empty", "SELECT 'default' AS id, 'My Library' AS name, '' AS description, '#3db8a0' AS color, CAST(7 AS BIGINT) AS created_at")
def q_seed_empty(spark: SparkSession, d: str) -> DataFrame:
    """A library without collections gets the default one."""
    return M.seeded(read_table(spark, d, "knowledge_bases").where(F.lit(False)), 7)


@query("q_clear_counts", "SELECT * FROM (VALUES ('knowledge_bases', 1), ('papers', 0), ('conversations', 0), ('messages', 0), ('section_leaves', 0)) v(table_name, rows)")
def q_clear_counts(spark: SparkSession, d: str) -> DataFrame:
    from .change_queries import counts

    return counts(M.cleared({t: read_table(spark, d, t) for t in ("knowledge_bases", "papers", "conversations", "messages", "section_leaves")}, 0)).select("table_name", F.col("rows").cast("int").alias("rows"))


@query("q_clamped", "SELECT paper_id, page_no, greatest(0.5, least(3.0, CAST(page_no AS DOUBLE) / 4)) AS zoom, greatest(25.0, least(75.0, CAST(page_no AS DOUBLE) * 10)) AS split FROM paper_pages")
def q_clamped(spark: SparkSession, d: str) -> DataFrame:
    page = F.col("page_no").cast("double")
    return pages_of(spark, d).select("paper_id", "page_no", T.clamped(page / 4, 0.5, 3.0).alias("zoom"), T.clamped(page * 10, 25.0, 75.0).alias("split"))


@query(
    "q_rating_prompts",
    f"""WITH {STORED}, per AS (SELECT paper_id, count(*) AS n, string_agg('[' || leaf_no || '] ' || coalesce(title, '') || ': ' || coalesce(summary, ''), E'\\n' ORDER BY leaf_no) AS sections FROM stored GROUP BY paper_id)
        SELECT paper_id, 'What is new?' AS query, E'Rate how well each section answers the question, 0 to 10.\\nQuestion: What is new?\\n' || sections || E'\\nAnswer with a JSON array of objects holding id and score.' AS prompt FROM per WHERE n > 1""",
)
def q_rating_prompts(spark: SparkSession, d: str) -> DataFrame:
    leaves = stored_leaves(spark, d)
    return R.rating_prompt(leaves, leaves.select("paper_id", F.lit("What is new?").alias("query")).distinct())


WORDS = r"list_filter(regexp_split_to_array(p, '[\s\x{1C}-\x{1F}\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '')"
LAST = "array_to_string(w[greatest(len(w) - 11, 1):len(w)], ' ')"
BUILT = rf"""{ALL_LEAVES}, texts AS (SELECT l.paper_id, l.leaf_no, string_agg(p.text, E'\n\n' ORDER BY p.page_no) AS text FROM leaves l JOIN pages p ON p.paper_id = l.paper_id AND p.page_no BETWEEN l.start_page AND l.end_page GROUP BY l.paper_id, l.leaf_no),
asked AS (SELECT paper_id, leaf_no, start_page, end_page, 'Describe these pages of a paper (Pages ' || (start_page + 1) || '–' || (end_page + 1) || E').\n' || substring(coalesce(text, ''), 1, 3000) || E'\nAnswer with a JSON object holding title and summary.' AS p FROM leaves LEFT JOIN texts USING (paper_id, leaf_no)),
told AS (SELECT *, 'Section of ' || length(p) || ' characters' AS title, {LAST} AS summary FROM (SELECT *, {WORDS} AS w FROM asked)),
per AS (SELECT paper_id, CAST(count(*) AS INTEGER) AS n_leaves, string_agg('[' || (leaf_no + 1) || '] ' || title || ': ' || summary, E'\n' ORDER BY leaf_no) AS listing, max(end_page) AS end_page, min_by(title, leaf_no) AS only_title, min_by(summary, leaf_no) AS only_summary FROM told GROUP BY paper_id
UNION ALL SELECT DISTINCT id, 0, '', -1, NULL, NULL FROM papers WHERE id IS NOT NULL AND id NOT IN (SELECT paper_id FROM leaves)),
outlined AS (SELECT *, E'Outline a paper with these sections.\n' || listing || E'\nAnswer with a JSON object holding title and summary.' AS p FROM per)
SELECT paper_id, CASE WHEN n_leaves = 1 THEN only_title ELSE 'Section of ' || length(p) || ' characters' END AS title, CASE WHEN n_leaves = 1 THEN only_summary ELSE {LAST} END AS summary, 0 AS start_page, end_page, n_leaves FROM (SELECT *, {WORDS} AS w FROM outlined)"""


@query("q_leaf_summaries", BUILT)
def q_leaf_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Roots of freshly built indexes of all papers, with pages or without, by the offline stand-in for a model."""
    return S.build_index(pages_of(spark, d), papers=read_table(spark, d, "papers"))[0]
