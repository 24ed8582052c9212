"""The queries pN_ of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans.registry import Registry
from paperloom.sources import read_table

from . import conversations, encoding, language, leakage, names, nearcopies, packing, pairs, splitting

REGISTRY = Registry()

P3_SQL = r"""WITH said AS (
  SELECT DISTINCT lower(trim(conversation_id)) AS c, lower(trim(id)) AS id, CASE WHEN timestamp >= 100000000000 THEN timestamp // 1000 ELSE timestamp END AS second,
    CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'ai', 'bot') THEN 'assistant' ELSE 'none' END AS speaker, NOT regexp_matches(coalesce(content, ''), '[\p{L}\p{N}]') AS blank
  FROM (SELECT *, lower(trim(coalesce(role, ''))) AS r FROM messages) WHERE r <> 'system' AND trim(coalesce(conversation_id, '')) <> ''),
turns AS (SELECT *, lag(speaker) OVER w AS before, lead(speaker) OVER w AS after, lead(blank) OVER w AS after_blank FROM said WINDOW w AS (PARTITION BY c ORDER BY second, CASE WHEN speaker = 'user' THEN 0 ELSE 1 END, id)),
facts AS (SELECT c, bool_or(NOT blank) AS spoken, bool_or(speaker = 'none' OR (speaker = 'assistant' AND coalesce(before, 'assistant') = 'assistant')) AS broken,
  bool_or(speaker = 'user' AND NOT coalesce(after = 'assistant' AND NOT after_blank, false)) AS missing FROM turns GROUP BY c),
known AS (SELECT DISTINCT lower(trim(id)) AS k FROM conversations)
SELECT * FROM (SELECT coalesce(c, k) AS conversation_id, CASE WHEN NOT coalesce(spoken, false) THEN 'empty' WHEN k IS NULL OR broken THEN 'broken' WHEN missing THEN 'missing_reply' END AS reason FROM facts FULL JOIN known ON c = k) WHERE reason IS NOT NULL"""

P3_TURNS_SQL = rf"""WITH dropped AS ({P3_SQL}),
rows AS (SELECT lower(trim(conversation_id)) AS c, lower(trim(id)) AS id, CASE WHEN timestamp >= 100000000000 THEN timestamp // 1000 ELSE timestamp END AS second, CASE WHEN r IN ('user', 'human') THEN 'user' ELSE 'assistant' END AS speaker,
  regexp_replace(content, '^[\s\x{{A0}}\x{{3000}}\x{{FEFF}}]+|[\s\x{{A0}}\x{{3000}}\x{{FEFF}}]+$', '', 'g') AS content FROM (SELECT *, lower(trim(coalesce(role, ''))) AS r FROM messages) WHERE r <> 'system' AND trim(coalesce(conversation_id, '')) <> ''),
once AS (SELECT c, id, min(second) AS second, min(speaker) AS speaker, max(content) AS content FROM rows GROUP BY c, id)
SELECT c AS conversation_id, row_number() OVER (PARTITION BY c ORDER BY second, CASE WHEN speaker = 'user' THEN 0 ELSE 1 END, id) - 1 AS position, speaker, content FROM once WHERE c NOT IN (SELECT conversation_id FROM dropped)"""

P4_SQL = r"""WITH rows AS (SELECT lower(trim(id)) AS id, concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''), coalesce(file_name, '')) AS text FROM papers WHERE regexp_matches(coalesce(abstract, ''), '[\p{L}\p{N}]')),
once AS (SELECT id, max_by(text, length(text)) AS text FROM rows GROUP BY id),
words AS (SELECT id, regexp_extract_all(regexp_replace(lower(text), '([\x{4e00}-\x{9fff}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS w FROM once),
grams AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM words)),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id)
SELECT c.a AS paper_id_a, c.b AS paper_id_b FROM common c JOIN sizes x ON x.id = c.a JOIN sizes y ON y.id = c.b WHERE c.n >= 0.6 * (x.n + y.n - c.n)"""

P6_SQL = """WITH leaves AS (SELECT lower(trim(paper_id)) AS paper_id, leaf_no, max(summary) AS summary, min(start_page) AS start_page, max(end_page) AS end_page FROM section_leaves WHERE paper_id IS NOT NULL GROUP BY 1, 2),
pages AS (SELECT lower(trim(paper_id)) AS paper_id, page_no, max(length(coalesce(text, ''))) AS n FROM paper_pages WHERE paper_id IS NOT NULL AND page_no IS NOT NULL GROUP BY 1, 2),
sums AS (SELECT l.paper_id, l.leaf_no, sum(p.n) + 2 * (count(*) - 1) AS chars FROM leaves l JOIN pages p ON p.paper_id = l.paper_id AND p.page_no BETWEEN l.start_page AND l.end_page GROUP BY 1, 2)
SELECT paper_id, leaf_no, 'summary' AS field FROM leaves WHERE length(summary) > (SELECT min(max_size) FROM size_limits WHERE limit_name = 'summary')
UNION ALL SELECT paper_id, leaf_no, 'pages' FROM sums WHERE chars > (SELECT min(max_size) FROM size_limits WHERE limit_name = 'pages')"""

P8_SQL = r"""WITH items AS (SELECT item_id, coalesce(lower(lang), '') LIKE 'zh%' AS zh, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
item_words AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM items WHERE NOT zh)),
item_chars AS (SELECT item_id, substring(s, i, 24) AS k FROM (SELECT item_id, s, unnest(range(1, length(s) - 22)) AS i FROM (SELECT item_id, array_to_string(w, '') AS s FROM items WHERE zh))),
doc_words AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM docs)),
doc_chars AS (SELECT doc_id, substring(s, i, 24) AS k FROM (SELECT doc_id, s, unnest(range(1, length(s) - 22)) AS i FROM (SELECT doc_id, array_to_string(w, '') AS s FROM docs)))
SELECT DISTINCT doc_id, item_id FROM doc_words JOIN item_words USING (k) UNION SELECT DISTINCT doc_id, item_id FROM doc_chars JOIN item_chars USING (k)"""


@REGISTRY.add("p8_found", P8_SQL)
def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return leakage.found(read_table(spark, directory, "documents"), read_table(spark, directory, "eval_items"))


@REGISTRY.add("p8_overlaps")
def p8_overlaps(spark: SparkSession, directory: str) -> DataFrame:
    return leakage.leaked_items(read_table(spark, directory, "documents"), read_table(spark, directory, "eval_items"))


@REGISTRY.add("p9_found")
def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return encoding.found(read_table(spark, directory, "documents"))


@REGISTRY.add("p9_restored")
def p9_restored(spark: SparkSession, directory: str) -> DataFrame:
    return encoding.repaired(read_table(spark, directory, "documents"))


@REGISTRY.add("p5_found")
def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return language.found(*(read_table(spark, directory, t) for t in ("papers", "messages", "lang_labels")))


@REGISTRY.add("p5_segments")
def p5_segments(spark: SparkSession, directory: str) -> DataFrame:
    return language.languages(*(read_table(spark, directory, t) for t in ("papers", "messages", "lang_labels")))


def _tables(spark: SparkSession, directory: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, directory, name) for name in names]


@REGISTRY.add("p6_found", P6_SQL)
def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return splitting.found(*_tables(spark, directory, "section_leaves", "paper_pages", "size_limits"))


@REGISTRY.add("p6_pieces")
def p6_pieces(spark: SparkSession, directory: str) -> DataFrame:
    return splitting.pieces(*_tables(spark, directory, "section_leaves", "paper_pages", "size_limits"))


@REGISTRY.add("p7_containers")
def p7_containers(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack(*_tables(spark, directory, "documents", "size_limits"))


@REGISTRY.add("p7_certificate")
def p7_certificate(spark: SparkSession, directory: str) -> DataFrame:
    return packing.certificate(packing.pack(*_tables(spark, directory, "documents", "size_limits")))


@REGISTRY.add("p3_found", P3_SQL)
def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return conversations.found(*_tables(spark, directory, "conversations", "messages"))


@REGISTRY.add("p3_turns", P3_TURNS_SQL)
def p3_turns(spark: SparkSession, directory: str) -> DataFrame:
    return conversations.turns(*_tables(spark, directory, "conversations", "messages"))


@REGISTRY.add("p1_found")
def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return pairs.found(read_table(spark, directory, "messages"))


@REGISTRY.add("p1_judged")
def p1_judged(spark: SparkSession, directory: str) -> DataFrame:
    """Posteriors of every defect and the labels kept, as text."""
    out = pairs.judged(read_table(spark, directory, "messages"))
    score = [F.round(F.col("posteriors")[d], 4).alias(f"p_{d}") for d in pairs.DEFECTS]
    return out.select("message_id", *score, F.array_join("labels", ",").alias("labels"))


@REGISTRY.add("p4_found", P4_SQL)
def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return nearcopies.found(read_table(spark, directory, "papers"))


@REGISTRY.add("p4_groups")
def p4_groups(spark: SparkSession, directory: str) -> DataFrame:
    return nearcopies.groups(read_table(spark, directory, "papers"))


@REGISTRY.add("p2_found")
def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return names.found(read_table(spark, directory, "papers"))


@REGISTRY.add("p2_entities")
def p2_entities(spark: SparkSession, directory: str) -> DataFrame:
    return names.entities(read_table(spark, directory, "papers"))
