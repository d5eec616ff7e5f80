"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelyard.catalog.fixtures import event_k
from modelyard.catalog.registry import query
from modelyard.functions import text
from modelyard.operators import answers, documents
from modelyard.operators.documents import DEFAULT_DOCUMENTS, STAGE_DOCUMENTS
from modelyard.sources.tables import table

SPACE_SQL = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


@query(
    """SELECT doc_id, substr(token, 1, 2) || '...' || right(token, 2) AS masked, len(token) >= 20 AS ok,
           starts_with(token, 'AIza') AS expected_prefix
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'token = "([0-9a-f]{40})"', 1)) AS token FROM documents)"""
)
def credential_scan(spark, sf):
    tokens = table(spark, sf, "documents").select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})"'), F.lit(1))).alias("token")
    )
    return tokens.select(
        "doc_id",
        text.mask(F.col("token")).alias("masked"),
        text.credential_ok(F.col("token")).alias("ok"),
        text.credential_expected_prefix(F.col("token")).alias("expected_prefix"),
    )


@query("SELECT doc_id, len(text) - len(replace(text, chr(10), '')) + 1 AS lines, len(text) AS chars FROM documents")
def line_counts(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        text.line_count(F.col("text")).cast("bigint").alias("lines"),
        F.length("text").cast("bigint").alias("chars"),
    )


def multi_file_texts(spark, sf):
    """Every document written out as a text of several files, one of them twice and one empty."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    raw = F.concat(
        F.lit("A preamble.\n=== FILE: meta.yaml ===\nlang: unknown\n=== FILE: "), name,
        F.lit(" ===\n```text\n"), F.col("text"), F.lit("\n```\n\n=== FILE: empty.txt ===\n\n=== FILE:  meta.yaml ===\nlang: "),
        F.col("lang"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n=== SUMMARY ===\n From "), F.col("source"), F.lit(" \n"))).otherwise(""),
    )
    return table(spark, sf, "documents").select("doc_id", raw.alias("raw"))


@query(
    f"""WITH files AS (
      SELECT doc_id, 'd' || doc_id || '.txt' AS name, text AS content, source FROM documents
      WHERE trim(text, {SPACE_SQL}) <> ''
      UNION ALL SELECT doc_id, 'meta.yaml', 'lang: ' || lang, source FROM documents)
    SELECT doc_id, name, md5(content) AS content, len(content) AS chars,
           CASE WHEN doc_id % 2 = 0 THEN 'From ' || source ELSE 'Code generated successfully' END AS summary FROM files"""
)
def section_split(spark, sf):
    files = documents.split_files(multi_file_texts(spark, sf), "raw", ["doc_id"])
    return files.select(
        "doc_id", "name", F.md5("content").alias("content"), F.length("content").cast("bigint").alias("chars"), "summary"
    )


@query(
    f"""SELECT doc_id, 'd' || doc_id || '.txt' AS name, md5(trim(text, {SPACE_SQL})) AS content FROM documents
    UNION ALL SELECT doc_id, 'lang.yaml', md5('lang: ' || lang) FROM documents"""
)
def markdown_blocks(spark, sf):
    name = F.concat(F.lit("### d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    raw = F.concat(
        F.lit("Here are the files.\n\n"), name, F.lit("\n```text\n"), F.col("text"),
        F.lit("\n```\n\nand\nlang.yaml\n```yaml\nlang: "), F.col("lang"), F.lit("\n```\n"),
    )
    rows = table(spark, sf, "documents").select("doc_id", raw.alias("raw"))
    return documents.fenced_blocks(rows, "raw", ["doc_id"]).select("doc_id", "name", F.md5("content").alias("content"))


@query(
    """SELECT event_id, CASE WHEN NOT (event_type = 'error' AND k < 10) THEN k END AS k,
           NOT (event_type = 'error' AND k < 10) AS ok
    FROM (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
)
def fenced_json(spark, sf):
    """Fenced event properties, some of them cut short."""
    broken = (F.col("event_type") == "error") & (event_k() < 10)
    props = F.when(broken, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    raw = F.concat(F.lit(" ```json\n"), props, F.lit("\n```\n"))
    schema = T.StructType().add("k", "long")
    return (
        table(spark, sf, "events")
        .select("event_id", text.parse_json(text.strip_json_fence(raw), schema).alias("j"))
        .select("event_id", F.when(F.col("j.bad").isNull(), F.col("j.k")).alias("k"), F.col("j.bad").isNull().alias("ok"))
    )


@query(f"SELECT doc_id, md5(trim(text, {SPACE_SQL})) AS body FROM documents")
def front_matter(spark, sf):
    """Documents, most of them under a header, with the header taken off."""
    under = F.concat(F.lit("---\nlang: "), F.col("lang"), F.lit("\n---\n\n"), F.col("text"), F.lit("\n"))
    rows = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "es", text.strip(F.col("text"))).otherwise(under).alias("raw")
    )
    return rows.select("doc_id", F.md5(text.strip_front_matter(F.col("raw"))).alias("body"))


@query(
    f"""WITH turns AS (
      SELECT conv_id, turn, (CASE WHEN len(text) % 5 = 0 THEN chr(10) ELSE '' END) || replace(text, ', ', chr(10) || ' ' || chr(10))
             || (CASE WHEN len(text) % 3 = 0 THEN chr(10) ELSE '' END) AS content
      FROM conversations WHERE role = 'user'),
    lines AS (
      SELECT conv_id, turn, unnest(string_split(content, chr(10))) AS line,
             generate_subscripts(string_split(content, chr(10)), 1) AS n FROM turns),
    marked AS (
      SELECT *, trim(line, {SPACE_SQL}) = '' AS blank,
             lag(trim(line, {SPACE_SQL}) = '', 1, FALSE) OVER (PARTITION BY conv_id ORDER BY turn, n) AS blank_before,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, n) AS place FROM lines),
    kept AS (
      SELECT m.* FROM marked m
      LEFT JOIN (SELECT conv_id, min(place) AS stop FROM marked WHERE blank AND blank_before GROUP BY conv_id) s USING (conv_id)
      WHERE NOT blank AND (stop IS NULL OR place < stop)),
    joined AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY n) AS text FROM kept GROUP BY conv_id, turn),
    ends AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first, max(turn) OVER (PARTITION BY conv_id) AS last FROM joined),
    cut AS (SELECT conv_id, turn, last, CASE WHEN turn = first THEN ltrim(text, {SPACE_SQL}) ELSE text END AS text FROM ends)
    SELECT conv_id, turn, CASE WHEN turn = last THEN rtrim(text, {SPACE_SQL}) ELSE text END AS text FROM cut"""
)
def conversation_text(spark, sf):
    """What the user said, with line breaks put in so that blank lines occur within and between turns."""
    content = F.concat(
        F.when(F.length("text") % 5 == 0, "\n").otherwise(""),
        F.replace("text", F.lit(", "), F.lit("\n \n")),
        F.when(F.length("text") % 3 == 0, "\n").otherwise(""),
    )
    turns = (
        table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", content.alias("content"))
    )
    return documents.descriptions(turns, "conv_id", "turn", "content")


@query("SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND conv_id % 4 = 0")
def rejected_conversations(spark, sf):
    """Conversations in which every fourth user says nothing before two blank lines."""
    silent = F.when(F.col("turn") == 0, F.lit("\n \nlater")).otherwise(F.lit(" "))
    turns = (
        table(spark, sf, "conversations")
        .filter("role = 'user'")
        .select("conv_id", "turn", F.when(F.col("conv_id") % 4 == 0, silent).otherwise(F.col("text")).alias("content"))
    )
    return documents.rejected(turns, documents.descriptions(turns, "conv_id", "turn", "content"), "conv_id")


@query(
    """SELECT p_partkey, '- name: ' || p_name || chr(10) || '- brand: ' || p_brand || chr(10) || '- size: ' || p_size
           || chr(10) || '- export: None' AS spec,
           '- **type**: ' || p_type || chr(10) || '- **size**: ' || p_size AS answers
    FROM part"""
)
def render_map(spark, sf):
    spec = F.create_map(
        F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"),
        F.lit("export"), F.lit(None).cast("string"),
    )
    said = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select(
        "p_partkey", text.render_map(spec).alias("spec"), text.render_map(said, "**").alias("answers")
    )


@query(
    """SELECT c_custkey, 'Customer ' || c_name || ' of ' || n_name || ' buys for ' || c_mktsegment || '.' AS line
    FROM customer JOIN nation ON n_nationkey = c_nationkey"""
)
def fill_template(spark, sf):
    # The nation table is fixed at 25 rows; Catalyst sees its size and broadcasts it.
    joined = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")
    )
    line = text.fill_template(
        "Customer {name} of {nation} buys for {segment}.",
        name=F.col("c_name"), nation=F.col("n_name"), segment=F.col("c_mktsegment"),
    )
    return joined.select("c_custkey", line.alias("line"))


STAGES = (*STAGE_DOCUMENTS, "unheard of")
STAGES_SQL = ", ".join(f"({i}, '{s}')" for i, s in enumerate(STAGES))
WANTED_SQL = ", ".join(
    f"('{s}', {p}, '{d}')" for s in STAGES for p, d in enumerate(STAGE_DOCUMENTS.get(s, DEFAULT_DOCUMENTS))
)


@query(
    f"""WITH stages(id, stage) AS (VALUES {STAGES_SQL}), wanted(stage, position, name) AS (VALUES {WANTED_SQL}),
    requests AS (SELECT DISTINCT conv_id, stage FROM conversations JOIN stages ON id = conv_id % {len(STAGES)}),
    parts AS (
      SELECT conv_id, stage, position, '### From ' || name || ':' || chr(10)
             || COALESCE(text, '# ' || name || ' not found') || chr(10) || chr(10) || repeat('-', 80) || chr(10) AS part
      FROM requests JOIN wanted USING (stage)
      LEFT JOIN documents ON doc_id = conv_id * 13 + len(name))
    SELECT conv_id, stage, md5(string_agg(part, chr(10) ORDER BY position)) AS context FROM parts GROUP BY conv_id, stage"""
)
def context_assembly(spark, sf):
    """Conversations as requests of some stage; a listed name and the conversation make up a document id."""
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.col("conv_id") % len(STAGES) + 1).cast("int"))
    requests = table(spark, sf, "conversations").select("conv_id", stage.alias("stage"))
    known = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content"))
    key = F.col("conv_id") * 13 + F.length("name")
    context = documents.assembled_context(requests, known, "conv_id", "stage", key)
    return context.select("conv_id", "stage", F.md5("context").alias("context"))


@query(
    """SELECT lang, CASE WHEN contains(text, 'token = ') OR contains(text, 'License') OR contains(text, 'http')
                         THEN 'infrastructure' ELSE 'code' END AS kind, count(*) AS n
    FROM documents GROUP BY ALL"""
)
def error_class(spark, sf):
    kind = text.error_kind(F.col("text"), ("token = ", "License", "http"))
    return table(spark, sf, "documents").groupBy("lang", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def part_answers(spark, sf):
    """Answers made of the columns of each part; the input size is answered twice."""
    size = F.col("p_size").cast("string")
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("seq"), F.lit(topic).alias("topic"), answer.alias("answer"))
            for i, (topic, answer) in enumerate(
                (
                    ("Number of classes", F.concat(F.lit(" "), size)),
                    ("Input size", F.col("p_brand")),
                    ("Output shape", F.col("p_type")),
                    ("Batch size", F.lit("64")),
                    ("Pretrained weights", F.when(F.col("p_size") % 2 == 0, "Yes please").otherwise("no")),
                    ("Export format", F.col("p_name")),
                    ("class names", F.when(F.col("p_size") % 3 == 0, "7").otherwise("unknown")),
                    ("Input size", F.concat(F.col("p_brand"), F.lit(" again"))),
                    ("input shape", F.when(F.col("p_size") % 7 == 0, F.lit("1x28x28"))),
                )
            )
        ]
    )
    exploded = table(spark, sf, "part").select("p_partkey", F.inline(rows))
    return exploded.filter("answer is not null")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 7 ELSE p_size END::BIGINT AS num_classes,
           CASE WHEN p_size % 7 = 0 THEN '1x28x28' ELSE p_brand || ' again' END AS input_shape, p_type AS output_shape,
           p_size % 2 = 0 AS pretrained, p_name AS export_format
    FROM part"""
)
def answers_to_spec(spark, sf):
    return answers.answers_to_spec(part_answers(spark, sf), "p_partkey")


@query(
    """SELECT o_orderkey, 'prj-' || strftime(made, '%Y%m%d-%H%M%S') || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS id,
           strftime(made, '%Y-%m-%d %H:%M:%S') AS made_at, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS "unique"
    FROM (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS made FROM orders)"""
)
def id_roundtrip(spark, sf):
    at = F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    ids = table(spark, sf, "orders").select(
        "o_orderkey", text.build_id("prj", at, F.md5(F.col("o_orderkey").cast("string"))).alias("id")
    )
    return ids.select(
        "o_orderkey",
        "id",
        text.id_time(F.col("id"), "prj").cast("string").alias("made_at"),
        text.id_unique(F.col("id")).alias("unique"),
    )
