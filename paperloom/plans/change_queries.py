"""Queries that show the next snapshot after a change, and those over settings and model requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import mutate as M
from paperloom.operators import settings as S
from paperloom.sources import read_table

from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.add
# Which rows a change touches: ids that begin with these characters.
HIT = "substring(id, 1, 1) IN ('0', '1', '2')"


def hit(column: str = "id") -> F.Column:
    return F.substring(column, 1, 1).isin("0", "1", "2")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def children(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, d, t) for t in ("paper_pages", "section_roots", "section_leaves")}


def highlights(spark: SparkSession, d: str) -> DataFrame:
    """Section titles as marked passages, of which the test data has none."""
    leaves = read_table(spark, d, "section_leaves").where("paper_id is not null")
    return leaves.select(F.concat("paper_id", F.lit("#"), F.col("leaf_no").cast("string")).alias("id"), "paper_id").distinct()


@query(
    "q_paper_patch",
    f"""SELECT id, CASE WHEN {HIT} THEN 'Patched ' || id ELSE title END AS title, abstract, CASE WHEN {HIT} THEN 'done' ELSE status END AS status, file_name, added_at,
        coalesce(array_to_string(CASE WHEN {HIT} THEN ['patched'] ELSE tags END, '|'), '') AS tags_text, coalesce(array_to_string(authors, '|'), '') AS authors_text FROM papers""",
)
def q_paper_patch(spark: SparkSession, d: str) -> DataFrame:
    papers = read_table(spark, d, "papers")
    patches = papers.where(hit()).select("id").distinct().select(
        "id", F.concat(F.lit("Patched "), "id").alias("title"), F.lit(None).cast("string").alias("abstract"), F.lit("done").alias("status"), F.array(F.lit("patched")).alias("tags"), F.lit(True).alias("set_tags"), F.lit(None).cast("array<string>").alias("authors"), F.lit(False).alias("set_authors")
    )
    out = M.papers_patched(papers, patches)
    text = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(f"{c}_text")
    return out.select("id", "title", "abstract", "status", "file_name", "added_at", text("tags"), text("authors"))


@query("q_conv_patch", f"SELECT id, CASE WHEN {HIT} THEN 'Renamed' ELSE title END AS title, coalesce(array_to_string(CASE WHEN {HIT} AND substring(id, 2, 1) = '0' THEN [] ELSE paper_ids END, '|'), '') AS ids_text, created_at FROM conversations")
def q_conv_patch(spark: SparkSession, d: str) -> DataFrame:
    convs = read_table(spark, d, "conversations")
    empty = F.when(F.substring("id", 2, 1) == "0", F.array().cast("array<string>"))
    patches = convs.where(hit()).select("id").distinct().select("id", F.lit("Renamed").alias("title"), empty.alias("paper_ids"))
    return M.conversations_patched(convs, patches).select("id", "title", F.coalesce(F.array_join("paper_ids", "|"), F.lit("")).alias("ids_text"), "created_at")


GONE_KB = "gone AS (SELECT id FROM knowledge_bases WHERE id <> 'default' AND substring(id, 1, 1) IN ('0', '1', '2', '3', '4', '5')), gone_papers AS (SELECT id FROM papers WHERE knowledge_base_id IN (SELECT id FROM gone))"
PARTS = ("paper_pages", "section_roots", "section_leaves")


@query(
    "q_kb_delete_cascade",
    f"WITH {GONE_KB} SELECT 'knowledge_bases' AS table_name, count(*) AS rows FROM knowledge_bases WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'papers', count(*) FROM papers WHERE knowledge_base_id IS NULL OR knowledge_base_id NOT IN (SELECT id FROM gone)"
    + "".join(f" UNION ALL SELECT '{t}', count(*) FROM {t} WHERE paper_id IS NULL OR paper_id NOT IN (SELECT id FROM gone_papers)" for t in PARTS),
)
def q_kb_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    kbs = read_table(spark, d, "knowledge_bases")
    gone = kbs.where((F.col("id") != "default") & F.substring("id", 1, 1).isin(*"012345")).select("id")
    return counts(M.collections_removed(gone, kbs, read_table(spark, d, "papers"), children(spark, d)))


@query(
    "q_paper_delete_cascade",
    f"WITH gone AS (SELECT id FROM papers WHERE {HIT}) SELECT 'papers' AS table_name, count(*) AS rows FROM papers WHERE NOT ({HIT})"
    + "".join(f" UNION ALL SELECT '{t}', count(*) FROM {t} WHERE paper_id IS NULL OR paper_id NOT IN (SELECT id FROM gone)" for t in PARTS),
)
def q_paper_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    papers = read_table(spark, d, "papers")
    return counts(M.papers_removed(papers.where(hit()).select("id"), papers, children(spark, d)))


@query(
    "q_conv_delete",
    f"WITH gone AS (SELECT id FROM conversations WHERE {HIT}) SELECT 'conversations' AS table_name, count(*) AS rows FROM conversations WHERE NOT ({HIT}) UNION ALL SELECT 'messages', count(*) FROM messages WHERE conversation_id IS NULL OR conversation_id NOT IN (SELECT id FROM gone)",
)
def q_conv_delete(spark: SparkSession, d: str) -> DataFrame:
    convs = read_table(spark, d, "conversations")
    return counts(M.conversations_removed(convs.where(hit()).select("id"), convs, read_table(spark, d, "messages")))


@query(
    "q_index_upsert",
    """WITH fresh AS (SELECT DISTINCT id AS paper_id FROM papers WHERE substring(id, 1, 1) IN ('0', '1', '2'))
       SELECT paper_id, title, summary, start_page, end_page, n_leaves FROM section_roots WHERE paper_id NOT IN (SELECT paper_id FROM fresh) UNION ALL SELECT paper_id, 'Fresh', '', 0, 0, 1 FROM fresh""",
)
def q_index_upsert(spark: SparkSession, d: str) -> DataFrame:
    roots = read_table(spark, d, "section_roots").where("paper_id is not null")
    fresh = read_table(spark, d, "papers").where(hit()).select(F.col("id").alias("paper_id")).distinct()
    rows = fresh.select("paper_id", F.lit("Fresh").alias("title"), F.lit("").alias("summary"), F.lit(0).alias("start_page"), F.lit(0).alias("end_page"), F.lit(1).alias("n_leaves"))
    return M.upserted(roots, rows, ["paper_id"])


@query(
    "q_message_insert",
    """WITH new AS (SELECT DISTINCT 'new-' || id AS id, id AS conversation_id FROM conversations UNION ALL SELECT 'orphan', 'no-such-conversation')
       SELECT count(*) AS messages, (SELECT count(*) FROM new WHERE conversation_id IN (SELECT id FROM conversations)) AS added FROM (SELECT id FROM messages UNION ALL SELECT id FROM new WHERE conversation_id IN (SELECT id FROM conversations))""",
)
def q_message_insert(spark: SparkSession, d: str) -> DataFrame:
    convs, messages = read_table(spark, d, "conversations"), read_table(spark, d, "messages")
    ids = convs.select(F.concat(F.lit("new-"), "id").alias("id"), F.col("id").alias("conversation_id")).distinct()
    ids = ids.unionByName(spark.createDataFrame([("orphan", "no-such-conversation")], "id string, conversation_id string"))
    rows = ids.select("id", "conversation_id", F.lit("user").alias("role"), F.lit("Hello?").alias("content"), F.array().cast("array<string>").alias("sources"), F.lit(0).cast("bigint").alias("timestamp"))
    after = M.inserted(messages, rows, "id", convs, "conversation_id")
    return after.agg(F.count("*").alias("messages"), F.count_if(F.col("id").startswith("new-")).alias("added"))


@query("q_clear_all", "SELECT 'default' AS id, 'My Library' AS name, '' AS description, '#3db8a0' AS color, CAST(0 AS BIGINT) AS created_at")
def q_clear_all(spark: SparkSession, d: str) -> DataFrame:
    return M.cleared({"knowledge_bases": read_table(spark, d, "knowledge_bases"), "papers": read_table(spark, d, "papers")}, 0)["knowledge_bases"]


PROFILES = '[{"id":"p1","name":"Local","provider":"ollama","model":"llama3","apiKey":"","baseUrl":"http://localhost:11434","temperature":0.2,"maxTokens":512,"topK":40,"systemPrompt":"Be brief."},{"id":"p2","name":"Hosted","provider":"anthropic","model":"m","apiKey":"k-123","baseUrl":"https://example.org","temperature":0.7,"maxTokens":2048,"topK":0,"systemPrompt":""}]'
OLD = '{"provider":"ollama","model":"old-model","temperature":0.1}'
SETTINGS = f"settings AS (SELECT * FROM (VALUES ('llm_profiles', '{PROFILES}'), ('chat_profile', '\"p2\"'), ('theme', '\"dark\"')) v(key, value))"


def settings(spark: SparkSession, *extra: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame([("llm_profiles", PROFILES), ("chat_profile", '"p2"'), ("theme", '"dark"'), *extra], "key string, value string")


@query("q_settings_get", f"WITH {SETTINGS} SELECT value FROM settings WHERE key = 'theme'")
def q_settings_get(spark: SparkSession, d: str) -> DataFrame:
    return S.setting(settings(spark), "theme")


@query("q_settings_upsert", f"WITH {SETTINGS} SELECT key, value FROM settings WHERE key NOT IN ('theme', 'zoom') UNION ALL SELECT * FROM (VALUES ('theme', '\"light\"'), ('zoom', '1.5')) v(key, value)")
def q_settings_upsert(spark: SparkSession, d: str) -> DataFrame:
    return M.upserted(settings(spark), spark.createDataFrame([("theme", '"light"'), ("zoom", "1.5")], "key string, value string"), ["key"])


@query("q_settings_export", f"WITH {SETTINGS} SELECT key, regexp_replace(value, '\"apiKey\":\"[^\"]*\"', '\"apiKey\":\"\"', 'g') AS value FROM settings")
def q_settings_export(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.sources.export import redacted

    return redacted(settings(spark))


@query("q_profile_resolve", "SELECT * FROM (VALUES (1, 'p1'), (2, 'p2'), (3, 'p2')) v(request, resolved)")
def q_profile_resolve(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "p1"), (2, "gone"), (3, None)], "request int, profile_id string")
    return S.resolved(asked, S.profiles(settings(spark)), "p2")


@query("q_profile_migrate", "SELECT 'default' AS id, 'Default' AS name, 'ollama' AS provider, 'old-model' AS model, CAST(0.1 AS DOUBLE) AS temperature, 2048 AS max_tokens, 0 AS top_k")
def q_profile_migrate(spark: SparkSession, d: str) -> DataFrame:
    old = spark.createDataFrame([("llm_config", OLD)], "key string, value string")
    return S.migrated(old).select("id", "name", "provider", "model", "temperature", F.col("maxTokens").alias("max_tokens"), F.col("topK").alias("top_k"))


@query("q_profile_edit", "SELECT * FROM (VALUES (0, 'p1', 'Renamed', 'llama3'), (1, 'default', 'Default', 'gpt-4o')) v(pos, id, name, model)")
def q_profile_edit(spark: SparkSession, d: str) -> DataFrame:
    """A profile is added, one renamed, one removed."""
    known = S.profiles(settings(spark))
    new = spark.createDataFrame([tuple(S.DEFAULT_PROFILE.values())], "id string, name string, provider string, model string, apiKey string, baseUrl string, temperature double, maxTokens int, topK int, systemPrompt string")
    patch = spark.createDataFrame([("p1", "Renamed")], "id string, name string")
    out = S.profile_removed(S.profile_updated(S.profile_added(known, new), patch), "p2")
    from pyspark.sql import Window

    return out.select((F.row_number().over(Window.orderBy("pos")) - 1).alias("pos"), "id", "name", "model")


@query("q_kb_insert", "SELECT id, name FROM knowledge_bases UNION ALL SELECT 'fresh', 'Fresh'")
def q_kb_insert(spark: SparkSession, d: str) -> DataFrame:
    kbs = read_table(spark, d, "knowledge_bases")
    rows = spark.createDataFrame([("fresh", "Fresh", "", "#000000", 0), ("default", "Again", "", "#000000", 0)], "id string, name string, description string, color string, created_at bigint")
    return M.inserted(kbs, rows, "id").select("id", "name")


@query("q_kb_seed", "SELECT count(*) AS collections, count(*) FILTER (id = 'default') AS defaults FROM knowledge_bases")
def q_kb_seed(spark: SparkSession, d: str) -> DataFrame:
    """A library that has collections is not seeded again."""
    return M.seeded(read_table(spark, d, "knowledge_bases"), 0).agg(F.count("*").alias("collections"), F.count_if(F.col("id") == "default").alias("defaults"))


@query("q_highlight_delete", "SELECT count(*) AS highlights FROM (SELECT DISTINCT paper_id || '#' || leaf_no AS id FROM section_leaves WHERE paper_id IS NOT NULL AND leaf_no <> 0)")
def q_highlight_delete(spark: SparkSession, d: str) -> DataFrame:
    """Section titles stand for highlights; those of first sections are removed."""
    marks = read_table(spark, d, "section_leaves").where("paper_id is not null").select(F.concat("paper_id", F.lit("#"), F.col("leaf_no").cast("string")).alias("id"), "leaf_no").distinct()
    return M.without(marks, marks.where("leaf_no = 0").select("id"), "id").select("id").distinct().agg(F.count("*").alias("highlights"))


@query(
    "q_request_shape",
    """SELECT id, timestamp, CASE ascii(substring(id, 1, 1)) % 3 WHEN 0 THEN '{"model":"m","messages":1,"stream":false,"options":{"top_k":40}}' WHEN 1 THEN '{"model":"m","messages":1,"temperature":0.7,"max_tokens":2048,"top_k":40}'
       ELSE '{"model":"m","messages":1,"temperature":0.7,"max_tokens":2048}' END AS body FROM messages""",
)
def q_request_shape(spark: SparkSession, d: str) -> DataFrame:
    kind = F.ascii(F.substring("id", 1, 1)) % 3
    provider = F.when(kind == 0, "ollama").when(kind == 1, "anthropic").otherwise("openai")
    return read_table(spark, d, "messages").select("id", "timestamp", S.request_body(provider, F.lit("m"), F.lit(1), F.lit(0.7), F.lit(2048), F.lit(40)).alias("body"))


@query("q_reply_extract", "SELECT id, timestamp, CASE WHEN ascii(substring(id, 1, 1)) % 3 = 2 THEN '' ELSE coalesce(role, '') END AS reply FROM messages")
def q_reply_extract(spark: SparkSession, d: str) -> DataFrame:
    kind = F.ascii(F.substring("id", 1, 1)) % 3
    said = F.coalesce("role", F.lit(""))
    message = F.struct(said.alias("content"))
    body = F.when(kind == 0, F.to_json(F.struct(message.alias("message")))).when(kind == 1, F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))).otherwise(F.lit('{"error":"busy"}'))
    provider = F.when(kind == 0, "ollama").otherwise("openai")
    return read_table(spark, d, "messages").select("id", "timestamp", S.reply_text(provider, body).alias("reply"))


def links_checked(messages: DataFrame) -> DataFrame:
    return messages.select("id", "timestamp", T.allowed_url(F.col("content")).alias("allowed"), (T.trimmed(F.coalesce("content", F.lit(""))) != "").alias("sendable"))


#: White space in the wide sense as DuckDB's pattern language writes it.
WIDE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@query("q_link_check", f"SELECT id, timestamp, regexp_matches(lower(coalesce(content, '')), '^https?:') AS allowed, NOT regexp_full_match(coalesce(content, ''), '{WIDE}*') AS sendable FROM messages")
def q_link_check(spark: SparkSession, d: str) -> DataFrame:
    return links_checked(read_table(spark, d, "messages"))
