"""Queries over datasets: profiles, rules, splits, batches, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelyard.catalog.registry import query
from modelyard.functions.text import url_path
from modelyard.operators import checks, profile, splits
from modelyard.operators.checks import Rule
from modelyard.plans import readiness
from modelyard.session import new_folder
from modelyard.sources import files, tables
from modelyard.sources.tables import table

PAGE_PATH_SQL = r"""
paths AS (
  SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*/([^?#]*)', 1) AS path FROM pages),
parts AS (
  SELECT page_id, lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS ext,
         CASE WHEN path LIKE '%/%' AND regexp_extract(path, '^(.*)/[^/]*$', 1) <> ''
              THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir
  FROM paths)
"""
PROFILE_SQL = f"""
WITH {PAGE_PATH_SQL}
SELECT 'total' AS kind, '' AS key, count(*) AS n FROM parts
UNION ALL SELECT 'ext', ext, count(*) FROM parts GROUP BY ext
UNION ALL SELECT 'dir', dir, count(*) FROM parts GROUP BY dir
"""

MINIMUM, RECOMMENDED = 50, 55

LINEITEM_RULES = (
    Rule("l_orderkey", "required", fix="fill the order key"),
    Rule("l_partkey", "required", fix="fill the part key"),
    Rule("l_quantity", "range", 1, 50, fix="correct the quantity"),
    Rule("l_discount", "range", 0, 0.05, severity="warning", fix="review the discount"),
    Rule("l_returnflag", "allowed", allowed=("A", "N", "R"), fix="use a known flag"),
    Rule("l_linenumber", "positive", fix="number from one"),
)
DOCUMENT_RULES = (
    Rule("text", "required", fix="fill the text"),
    Rule("lang", "allowed_any_case", allowed=("en", "de", "fr"), severity="warning", fix="check the language"),
)
ORDER_RULES = (
    Rule("o_custkey", "required", fix="fill the customer"),
    Rule("o_orderstatus", "allowed_any_case", allowed=("f", "o", "p"), fix="use a known status"),
    Rule("o_totalprice", "positive", fix="correct the price"),
)

CHECKS_SQL = """
checks AS (
  SELECT 'lineitem' AS "table", 'l_orderkey required' AS rule, 'error' AS severity,
         count(*) FILTER (l_orderkey IS NULL) AS violations FROM lineitem
  UNION ALL SELECT 'lineitem', 'l_partkey required', 'error', count(*) FILTER (l_partkey IS NULL) FROM lineitem
  UNION ALL SELECT 'lineitem', 'l_quantity range', 'error',
                   count(*) FILTER (l_quantity < 1 OR l_quantity > 50) FROM lineitem
  UNION ALL SELECT 'lineitem', 'l_discount range', 'warning',
                   count(*) FILTER (l_discount < 0 OR l_discount > 0.05::DOUBLE) FROM lineitem
  UNION ALL SELECT 'lineitem', 'l_returnflag allowed', 'error',
                   count(*) FILTER (l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'N', 'R')) FROM lineitem
  UNION ALL SELECT 'lineitem', 'l_linenumber positive', 'error',
                   count(*) FILTER (l_linenumber IS NULL OR l_linenumber <= 0) FROM lineitem
  UNION ALL SELECT 'documents', 'text required', 'error', count(*) FILTER (text IS NULL) FROM documents
  UNION ALL SELECT 'documents', 'lang allowed_any_case', 'warning',
                   count(*) FILTER (lang IS NULL OR lower(lang) NOT IN ('en', 'de', 'fr')) FROM documents
  UNION ALL SELECT 'orders', 'o_custkey required', 'error', count(*) FILTER (o_custkey IS NULL) FROM orders
  UNION ALL SELECT 'orders', 'o_orderstatus allowed_any_case', 'error',
                   count(*) FILTER (o_orderstatus IS NULL OR lower(o_orderstatus) NOT IN ('f', 'o', 'p')) FROM orders
  UNION ALL SELECT 'orders', 'o_totalprice positive', 'error',
                   count(*) FILTER (o_totalprice IS NULL OR o_totalprice <= 0) FROM orders)
"""
SIZES_SQL = f"""
sizes AS (
  SELECT label, count(*) AS n,
         CASE WHEN count(*) < {MINIMUM} THEN 'error' WHEN count(*) < {RECOMMENDED} THEN 'warning' END AS severity
  FROM embeddings GROUP BY label)
"""
FINDINGS_SQL = f"""
{CHECKS_SQL}, {SIZES_SQL},
findings AS (
  SELECT * FROM checks
  UNION ALL SELECT 'embeddings', 'label minimum size', 'error', count(*) FILTER (severity = 'error') FROM sizes
  UNION ALL SELECT 'embeddings', 'label recommended size', 'warning', count(*) FILTER (severity = 'warning') FROM sizes),
rolled AS (
  SELECT "table",
         CASE max(CASE WHEN violations = 0 THEN 0 WHEN severity = 'error' THEN 2 ELSE 1 END)
              WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS status,
         count(*) AS checks, count(*) FILTER (violations > 0) AS broken,
         bool_and(violations = 0) AS all_passed,
         COALESCE(string_agg(rule, ', ' ORDER BY rule) FILTER (violations > 0), '') AS failing
  FROM findings GROUP BY "table")
"""


def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", url_path(F.col("url")).alias("path"))


def all_findings(spark: SparkSession, sf: str) -> DataFrame:
    checked = {
        "lineitem": (table(spark, sf, "lineitem"), LINEITEM_RULES),
        "documents": (table(spark, sf, "documents"), DOCUMENT_RULES),
        "orders": (table(spark, sf, "orders"), ORDER_RULES),
    }
    sizes = readiness.size_findings(table(spark, sf, "embeddings"), "embeddings", "label", MINIMUM, RECOMMENDED)
    return readiness.findings(checked, sizes)


@query(f"WITH {PAGE_PATH_SQL} SELECT ext, count(*) AS n FROM parts GROUP BY ext")
def path_ext_counts(spark, sf):
    return profile.extension_counts(page_paths(spark, sf), F.col("path"))


@query(f"WITH {PAGE_PATH_SQL} SELECT dir, count(*) AS n FROM parts GROUP BY dir")
def path_dir_counts(spark, sf):
    return profile.directory_counts(page_paths(spark, sf), F.col("path"))


@query(PROFILE_SQL)
def dataset_profile(spark, sf):
    return profile.dataset_profile(page_paths(spark, sf), F.col("path"))


@query("SELECT page_id, url FROM pages ORDER BY md5('42:' || page_id), page_id LIMIT 50")
def sample_rows(spark, sf):
    return profile.uniform_sample(table(spark, sf, "pages").select("page_id", "url"), "page_id")


@query(
    """SELECT 'embeddings.label' AS source, label, count(*) AS n FROM embeddings GROUP BY label
    UNION ALL SELECT 'labels.quality', quality, count(*) FROM labels GROUP BY quality
    UNION ALL SELECT 'labels.toxic', toxic, count(*) FROM labels GROUP BY toxic"""
)
def class_distribution(spark, sf):
    wanted = (("embeddings", "label"), ("labels", "quality"), ("labels", "toxic"))
    return checks.union_all(
        [
            profile.class_distribution(table(spark, sf, t), c).select(F.lit(f"{t}.{c}").alias("source"), "label", "n")
            for t, c in wanted
        ]
    )


@query(f"WITH {SIZES_SQL} SELECT label, n, severity FROM sizes")
def size_check(spark, sf):
    counts = profile.class_distribution(table(spark, sf, "embeddings"), "label")
    return profile.size_check(counts, MINIMUM, RECOMMENDED)


@query(f"WITH {CHECKS_SQL} SELECT * FROM checks")
def rule_checks(spark, sf):
    return checks.union_all(
        [
            checks.count_violations(table(spark, sf, "lineitem"), "lineitem", LINEITEM_RULES),
            checks.count_violations(table(spark, sf, "documents"), "documents", DOCUMENT_RULES),
            checks.count_violations(table(spark, sf, "orders"), "orders", ORDER_RULES),
        ]
    ).select("table", "rule", "severity", "violations")


@query(f"""WITH {FINDINGS_SQL} SELECT *, status <> 'fail' AS may_continue FROM rolled""")
def status_rollup(spark, sf):
    return readiness.readiness(all_findings(spark, sf))


@query(
    f"""WITH {FINDINGS_SQL} SELECT "table", severity, rule || ': ' || violations || ' rows' AS message
    FROM findings WHERE violations > 0"""
)
def issue_list(spark, sf):
    return checks.as_issues(all_findings(spark, sf)).drop("fix")


EXPECTED = {
    "documents": T.StructType()
    .add("doc_id", "long").add("text", "string").add("lang", "string").add("title", "string"),
    "labels": T.StructType().add("doc_id", "long").add("quality", "long").add("toxic", "integer"),
    "embeddings": T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.FloatType())).add("label", "integer"),
}


@query(
    """SELECT 'documents' AS "table", 'doc_id' AS "column", 'bigint' AS expected, 'bigint' AS "found", 'ok' AS verdict,
           count(doc_id) AS filled FROM documents
    UNION ALL SELECT 'documents', 'text', 'string', 'string', 'ok', count(text) FROM documents
    UNION ALL SELECT 'documents', 'lang', 'string', 'string', 'ok', count(lang) FROM documents
    UNION ALL SELECT 'documents', 'title', 'string', NULL, 'missing', 0
    UNION ALL SELECT 'labels', 'doc_id', 'bigint', 'bigint', 'ok', count(doc_id) FROM labels
    UNION ALL SELECT 'labels', 'quality', 'bigint', 'int', 'mistyped', count(quality) FROM labels
    UNION ALL SELECT 'labels', 'toxic', 'int', 'int', 'ok', count(toxic) FROM labels
    UNION ALL SELECT 'embeddings', 'vec_id', 'bigint', 'bigint', 'ok', count(vec_id) FROM embeddings
    UNION ALL SELECT 'embeddings', 'embedding', 'array<float>', 'array<float>', 'ok', count(embedding) FROM embeddings
    UNION ALL SELECT 'embeddings', 'label', 'int', 'int', 'ok', count(label) FROM embeddings"""
)
def schema_check(spark, sf):
    return checks.union_all([checks.column_check(table(spark, sf, t), t, s) for t, s in EXPECTED.items()])


@query(
    """SELECT doc_id, COALESCE(quality, 0) AS quality, COALESCE(toxic, 0) AS toxic
    FROM documents LEFT JOIN labels USING (doc_id)"""
)
def defaults_filled(spark, sf):
    joined = (
        table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    )
    return checks.fill_defaults(joined, {"quality": 0, "toxic": 0})


@query(
    """SELECT 'project_type allowed_any_case' AS rule, count(*) FILTER (lower(p_type) NOT IN ('vision', 'nlp', 'tabular',
           'time-series', 'multimodal', 'rl', 'other')) AS violations FROM part
    UNION ALL SELECT 'framework allowed_any_case', count(*) FILTER (p_size % 5 = 0) FROM part
    UNION ALL SELECT 'task required', count(*) FILTER (p_name IS NULL) FROM part
    UNION ALL SELECT 'num_classes range', count(*) FILTER (p_size < 2) FROM part"""
)
def spec_checks(spark, sf):
    """Parts read as project specifications."""
    kinds = F.when(F.col("p_size") % 5 == 0, "Caffe").otherwise("PyTorch")
    specs = table(spark, sf, "part").select(
        F.col("p_type").alias("project_type"),
        kinds.alias("framework"),
        F.col("p_name").alias("task"),
        F.col("p_size").alias("num_classes"),
    )
    return checks.count_violations(specs, "specs", checks.SPEC_RULES).select("rule", "violations")


@query(
    """SELECT p_partkey, lower(p_type) AS project_type, lower(p_brand) AS framework,
           CASE WHEN p_size % 4 = 0 THEN 'custom' ELSE p_name END AS dataset_source, p_size % 3 = 1 AS pretrained,
           'medium' AS compute_budget, 'balanced' AS latency_priority, CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS requirements
    FROM part"""
)
def spec_defaults(spark, sf):
    """Parts read as specifications that leave some fields open."""
    specs = table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_type").alias("project_type"),
        F.col("p_brand").alias("framework"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_name")).alias("dataset_source"),
        F.when(F.col("p_size") % 3 == 1, F.lit(True)).alias("pretrained"),
        F.lit(None).cast("string").alias("compute_budget"),
        F.lit(None).cast("string").alias("latency_priority"),
        F.when(F.col("p_size") % 7 == 0, F.create_map(F.lit("metric"), F.col("p_type"))).alias(checks.OPEN_MAP),
    )
    return checks.clean_specs(specs).withColumn("requirements", F.size(checks.OPEN_MAP)).drop(checks.OPEN_MAP)


@query(
    """SELECT source, count(*) AS n, source NOT IN ('src0', 'src3') AS needs_validation
    FROM documents GROUP BY source"""
)
def source_gate(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("needs_validation", ~checks.known_source(F.col("source"), ("src0", "src3")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_items(spark, sf):
    """Documents that nobody has labelled."""
    return checks.missing_items(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query(
    """SELECT quality, count(DISTINCT d.doc_id) > 0 AS "found"
    FROM (VALUES (0), (1), (2)) q(quality) LEFT JOIN labels l USING (quality) LEFT JOIN documents d ON d.doc_id = l.doc_id
    GROUP BY quality"""
)
def any_found(spark, sf):
    """Has any document a label of each kind; there is no kind 2."""
    expected, labels = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    return checks.union_all(
        [
            checks.any_found(expected, labels.filter(F.col("quality") == kind), "doc_id").select(F.lit(kind).alias("quality"), "found")
            for kind in (0, 1, 2)
        ]
    )


@query(
    """SELECT 'severity allowed' AS rule, count(*) FILTER (p_size % 3 = 2) AS violations FROM part
    UNION ALL SELECT 'message required', count(*) FILTER (p_size % 4 = 0) FROM part
    UNION ALL SELECT 'fix required', count(*) FILTER (p_type IS NULL) FROM part
    UNION ALL SELECT 'status allowed', count(*) FILTER (o_orderstatus <> 'F') FROM orders"""
)
def issue_checks(spark, sf):
    """Parts read as issues, and orders as results, where only one status is written as it should be."""
    severity = F.when(F.col("p_size") % 3 == 0, "error").when(F.col("p_size") % 3 == 1, "warning").otherwise("Error")
    issues = table(spark, sf, "part").select(
        severity.alias("severity"), F.when(F.col("p_size") % 4 != 0, F.col("p_name")).alias("message"), F.col("p_type").alias("fix")
    )
    status = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "PASS")
    results = table(spark, sf, "orders").select(status.alias("status"))
    return checks.union_all(
        [
            checks.count_violations(issues, "issues", checks.ISSUE_RULES),
            checks.count_violations(results, "results", checks.RESULT_RULES),
        ]
    ).select("rule", "violations")


@query(
    """SELECT count(*) AS n, count(*) FILTER (regexp_matches(url, '^https://[a-z.]+/')) AS matching,
           count(*) FILTER (regexp_matches(url, '^https://[a-z.]+/')) / count(*) AS share FROM pages"""
)
def naming_share(spark, sf):
    return profile.naming_share(table(spark, sf, "pages"), F.col("url"), "^https://[a-z.]+/")


@query(
    """SELECT label, split, count(*) AS n FROM (
      SELECT label, CASE WHEN CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 < 8
                         THEN 'train' ELSE 'test' END AS split FROM embeddings)
    GROUP BY label, split"""
)
def train_test_split(spark, sf):
    split = splits.train_test_split(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    return split.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT vec_id, position, position // 64 AS batch FROM (
      SELECT vec_id, row_number() OVER (ORDER BY md5('42:1:' || vec_id), vec_id) - 1 AS position FROM embeddings)"""
)
def shuffle_batches(spark, sf):
    return splits.shuffled_batches(table(spark, sf, "embeddings").select("vec_id"), "vec_id", epoch=1)


@query(
    """SELECT o_orderkey, position, position // 64 AS batch FROM (
      SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders)"""
)
def ordered_batches(spark, sf):
    return splits.ordered_batches(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    """SELECT batch, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM (
      SELECT value, (row_number() OVER (ORDER BY md5('42:1:' || event_id), event_id) - 1) // 64 AS batch FROM events)
    GROUP BY batch HAVING batch % 100 = 0"""
)
def every_nth(spark, sf):
    """Sum of a batch, reported for every hundredth batch."""
    batched = splits.shuffled_batches(table(spark, sf, "events").select("event_id", "value"), "event_id", epoch=1)
    totals = batched.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")
    )
    return splits.every_nth(totals, F.col("batch"))


@query("SELECT label, n, ceil(n / 64.0)::BIGINT AS batches FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def batches_per_epoch(spark, sf):
    counts = profile.class_distribution(table(spark, sf, "embeddings"), "label")
    return counts.withColumn("batches", profile.batch_count(F.col("n")))


@query(
    f"""WITH {PAGE_PATH_SQL.strip()}, {FINDINGS_SQL.strip()}
    SELECT 'total' AS kind, '' AS key, count(*) AS n FROM parts
    UNION ALL SELECT 'ext', ext, count(*) FROM parts GROUP BY ext
    UNION ALL SELECT 'dir', dir, count(*) FROM parts GROUP BY dir
    UNION ALL SELECT 'class', CAST(label AS VARCHAR), count(*) FROM embeddings GROUP BY label
    UNION ALL SELECT 'path', 'pages', 1
    UNION ALL SELECT 'status', CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END)
                               WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END, 1 FROM rolled
    UNION ALL (SELECT 'sample', path, 1 FROM paths ORDER BY md5('42:' || page_id), page_id LIMIT 10)
    UNION ALL SELECT 'issue ' || severity, rule || ': ' || violations || ' rows', 1 FROM findings WHERE violations > 0"""
)
def manifest_roundtrip(spark, sf):
    """Profile and issues as read back from the manifest they were written to."""
    path = new_folder(spark, "manifest")
    findings = all_findings(spark, sf)
    status = findings.agg(checks.status_of(F.when(F.col("violations") > 0, F.col("severity")))).first()[0]
    classes = profile.class_distribution(table(spark, sf, "embeddings"), "label")
    whole = profile.described(page_paths(spark, sf), F.col("path"), "page_id", classes, "pages", status)
    tables.write_manifest(whole, checks.as_issues(findings), path)
    issues = tables.read_issues(spark, path).select(
        F.concat(F.lit("issue "), "severity").alias("kind"), F.col("message").alias("key"), F.lit(1).cast("bigint").alias("n")
    )
    return tables.read_profile(spark, path).unionByName(issues)


@query(
    """SELECT doc_id AS project_id, md5(COALESCE('{"quality":' || quality || ',"toxic":' || toxic || '}', c.text,
           'Dataset source: ' || source)) AS context
    FROM documents LEFT JOIN labels USING (doc_id)
    LEFT JOIN (SELECT conv_id AS doc_id, text FROM conversations WHERE turn = 0) c USING (doc_id)"""
)
def data_context(spark, sf):
    projects = table(spark, sf, "documents").select(
        F.col("doc_id").alias("project_id"), F.col("source").alias("dataset_source")
    )
    manifests = table(spark, sf, "labels").select(
        F.col("doc_id").alias("project_id"), F.to_json(F.struct("quality", "toxic")).alias("manifest")
    )
    requirements = (
        table(spark, sf, "conversations")
        .filter("turn = 0")
        .select(F.col("conv_id").alias("project_id"), F.col("text").alias("requirements"))
    )
    known = tables.data_context(projects, manifests, requirements)
    return known.select("project_id", F.md5("context").alias("context"))


KNOWN_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


@query(
    f"""SELECT name || '.parquet' AS relative, name || '.parquet' AS name, '.parquet' AS ext, '.' AS dir, true AS filled, regions
    FROM (VALUES {", ".join(f"('{t}')" for t in KNOWN_TABLES)}) t(name), (SELECT count(*) AS regions FROM region)"""
)
def visible_files(spark, sf):
    """Files of the dataset folder itself, with the rows that one of them holds."""
    found = files.visible(files.list_files(spark, sf)).select("relative", "name", "ext", "dir", (F.col("length") > 0).alias("filled"))
    return found.withColumn("regions", F.lit(table(spark, sf, "region").count()))


@query(
    """SELECT 'lang=' || coalesce(lang, '__HIVE_DEFAULT_PARTITION__') || '/part=' || (doc_id % 7) AS dir,
      CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes FROM documents GROUP BY ALL"""
)
def listed_bytes(spark, sf):
    """Bytes per directory of a dataset of files, found by listing what the documents were written to."""
    folder = new_folder(spark, "listed")
    documents = table(spark, sf, "documents").select("lang", (F.col("doc_id") % 7).alias("part"), F.coalesce("text", F.lit("")).alias("value"))
    documents.write.partitionBy("lang", "part").text(folder)
    found = files.visible(files.list_files(spark, folder)).filter(F.col("ext") == ".txt")
    return found.groupBy("dir").agg(F.sum("length").alias("bytes"))


@query(
    r"""SELECT page_id, name FROM (SELECT page_id,
      regexp_replace(regexp_extract(regexp_extract(url, '^[^?#]*', 0), '[^/]*$', 0), '^[13579]', '.') AS name FROM pages)
    WHERE name NOT LIKE '.%'"""
)
def visible_names(spark, sf):
    """Page names that are not hidden; a leading odd digit counts as a dot."""
    path = F.regexp_extract("url", r"^[^?#]*", 0)
    name = F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), "^[13579]", ".")
    return files.visible(table(spark, sf, "pages").select("page_id", name.alias("name")))


@query(
    PROFILE_SQL + "UNION ALL (SELECT 'sample', path, 1 FROM paths ORDER BY md5('42:' || page_id), page_id LIMIT 50)"
)
def profile_added(spark, sf):
    """The profile of all pages, merged out of the summaries that three parts of them were noted with, one of them twice."""
    path, pages = new_folder(spark, "manifest"), page_paths(spark, sf)
    for part in (0, 1, 2, 1):
        own = pages.filter(F.coalesce(F.pmod("page_id", F.lit(3)), F.lit(0)) == part)
        tables.add_summary(profile.summary(own, F.col("path"), "page_id"), path, f"pages-{part}")
    return tables.read_summary(spark, path).select("kind", "key", "n")
