"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelyard.llm import (
    chat, decontaminate, jaccard, language, mixing, negatives, neighbours, quality, search, tokens, toxicity, urls, warc,
)
from modelyard.llm.learning import held_out
from modelyard.session import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CONTROL_TURN = "</s>[INST] ok [/INST]"


@_query(r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, length(regexp_replace(text, '(<|\[)(\\*)(s>|/s>|SYS\]|/SYS\]|INST\]|/INST\]|ANS\]|ROLE\]|/ROLE\]|TEXT\])',
                                  '\1\\\2\3', 'g')) AS n,
    CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 ELSE 23 + length(role) END AS marks,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') || '>' || role AS move
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + marks) AS BIGINT) AS formatted_chars, true AS loss_agrees,
  bool_and(move IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user'))
    AND last(role ORDER BY turn, role, text) = 'assistant' AS valid
FROM marked GROUP BY conv_id
""")
def op1_chat_formatting(spark, sf_dir):
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL_TURN).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(rows.unionByName(extra)))


def _sql_mixed(x: str, salt: str) -> str:
    return f"((((({x}) % {mixing.PRIME}) * 48271 + ({salt}) * 40692 + 12345) % {mixing.PRIME}) * 1103515245 + 69621) % {mixing.PRIME}"


def _sql_step(x: str, add: str) -> str:
    first, second = mixing.STEPS
    return f"(({x}) * ((CASE WHEN \"full\" % {first} = 0 THEN {second} ELSE {first} END) % \"full\") + {add}) % \"full\""


#: Whole passes take every document once; of the last pass, the blocks that the permutation puts first.
MIX_SQL = rf"""
WITH sized AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    coalesce(md5(text), '') AS digest,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {mixing.BUCKETS} AS bucket
  FROM documents
), sources AS (
  SELECT source, source_size, sid, (sid - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source)
), filled AS (
  SELECT *, row_number() OVER fill AS place,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM sources WINDOW fill AS (ORDER BY cap / weight, sid)
), last_level AS (SELECT place AS last_place, level AS last_level FROM filled WHERE cap / weight >= level ORDER BY place LIMIT 1),
quota AS (
  SELECT *, wanted - passes * source_size AS rest, source_size // 2048 AS "full" FROM (
    SELECT *, CAST(floor(target) AS BIGINT) AS wanted,
      CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM (
      SELECT sid, source, source_size, CASE WHEN place < last_place THEN CAST(cap AS DOUBLE)
        ELSE least(CAST(cap AS DOUBLE), weight * last_level) END AS target FROM filled, last_level))
), slots AS (
  SELECT *, unnest(range(0, (rest + 2047) // 2048)) AS j, sid * 31 + passes * 17 + 7 AS salt,
    CAST(floor(sqrt("full")) AS BIGINT) AS r FROM quota
), firsts AS (
  SELECT *, "full" // nullif(r, 0) AS c, CASE WHEN j < "full" THEN {_sql_step("j", _sql_mixed("salt", "1"))} END AS f FROM slots
), lefts AS (SELECT *, (f // c + {_sql_mixed("f % c", "salt + 1")}) % r AS l FROM firsts),
seconds AS (
  SELECT *, CASE WHEN f < r * c THEN l * c + (f % c + {_sql_mixed("l", "salt + 2")}) % c ELSE f END AS s FROM lefts
), taken_blocks AS (
  SELECT sid, CASE WHEN j < "full" THEN {_sql_step("s", _sql_mixed("salt", "3"))} ELSE j END AS block,
    least(CASE WHEN j < "full" THEN 2048 ELSE source_size % 2048 END, rest - j * 2048) AS words
  FROM seconds
), placed AS (
  SELECT d.*, sid, source_size, target, passes, CAST(sum(size) OVER (
    PARTITION BY sid ORDER BY bucket, doc_id NULLS FIRST, size, digest ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS first
  FROM sized d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source
), pieces AS (SELECT *, unnest(range(first // 2048, (first + size - 1) // 2048 + 1)) AS block FROM placed WHERE size > 0),
partial AS (
  SELECT rid, sum(greatest(0, least(first + size - block * 2048, 2048, words) - greatest(first - block * 2048, 0))) AS words
  FROM pieces JOIN taken_blocks USING (sid, block) GROUP BY rid
)
SELECT doc_id, size, source_size, target, CAST(passes * size + coalesce(words, 0) AS BIGINT) AS taken
FROM placed LEFT JOIN partial USING (rid)
"""


@_query(MIX_SQL)
def op4_mix_sources(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).taken()


@_query()
def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return tokens.token_counts(_table(spark, sf_dir, "documents"), path, limit=2048)


@_query(r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
classes AS (SELECT min(doc_id) AS doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
parts AS (SELECT doc_id, n, e FROM elements SEMI JOIN classes USING (doc_id)),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM parts a JOIN parts b ON a.e = b.e AND a.doc_id <> b.doc_id
    AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM classes UNION SELECT r.node, p.v FROM reach r JOIN pairs p ON r.seen = p.u
), component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
named AS (SELECT s, component_id FROM classes JOIN component ON doc_id = node)
SELECT x.doc_id, len(x.s) AS n_shingles, coalesce(component_id, x.doc_id) AS component_id
FROM sets x LEFT JOIN named ON list_sort(x.s) = named.s
""")
def op7_ngram_jaccard_join(spark, sf_dir):
    return jaccard.linked(_table(spark, sf_dir, "documents"), jaccard.JaccardSettings(words=3, percent=90))


@_query(r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), items AS (
  SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
    lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS win FROM item_words WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM items),
starts AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS pos FROM docs, sizes WHERE len(w) >= n
), hits AS (
  SELECT doc_id, pos, s.n, item_id FROM starts s JOIN items i ON s.n = i.n AND array_to_string(w[pos : pos + s.n - 1], ' ') = i.win
), per_doc AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN per_doc USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op10_decontamination(spark, sf_dir):
    documents, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.digests(decontaminate.contamination(documents, benchmark))


@_query()
def op3_quality_classifier(spark, sf_dir):
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    test = held_out(F.col("doc_id"), 5, 0)
    scored = quality.scored(documents.select("doc_id", "text"), quality.learned(documents, labels, ~test))
    return scored.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query()
def op5_toxicity(spark, sf_dir):
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    test = held_out(F.col("doc_id"), 5, 0)
    scored = toxicity.scored(documents, toxicity.learned(documents, labels, ~test), ["doc_id"])
    return scored.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query()
def op9_language_id(spark, sf_dir):
    documents, test = _table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 4, 2)
    network = language.learned(documents, ~test)
    found = language.identified(documents.select("doc_id", "text"), network)
    return found.select("doc_id", test.alias("held_out"), "lang_pred", "score")


@_query("""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
""")
def op2_warc(spark, sf_dir):
    archives = warc.written(_table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return warc.digests(warc.read(archives))


@_query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
""")
def op8_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query("""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
""")
def op11_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


@_query(r"""
WITH terms AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), corpus AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS length FROM terms),
counted AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM terms) GROUP BY ALL),
items AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted SEMI JOIN items USING (term), corpus GROUP BY term, docs
), worth AS (
  SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))) AS worth
  FROM counted JOIN weighed USING (term), corpus
), scores AS (
  SELECT item_id, rid, doc_id, CAST(sum(worth * times) AS BIGINT) AS score FROM worth JOIN items USING (term) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
""")
def op12_lexical_search(spark, sf_dir):
    return search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


URL_RULES = """
SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
AS rules(host, path, verdict)
"""


@_query()
def op13_url_filters(spark, sf_dir):
    judge = urls.learned(spark.createDataFrame(urls.labelled_urls(), "url string, label int"))
    found = urls.judged(_table(spark, sf_dir, "pages"), spark.sql(URL_RULES), judge)
    return found.select("page_id", "host", "path", "rule", "verdict")
