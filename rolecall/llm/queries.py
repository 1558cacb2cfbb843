"""Every operator as a query over the test tables, with a DuckDB counterpart where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontaminate, langid, lexical, mixing, near, ngrams, quality, repeats, spm, topk, urls, wordgrams
from .common import held_out, materialize, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if oracle is not None:
            ORACLES[run.__name__] = oracle
        return run
    return register


@query()
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document leaks, with the fewest word edits."""
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.size("item_ids") > 0)


@query()
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether they decode to its text."""
    rows = spm.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "piece_ids", F.size("piece_ids").alias("n_pieces"),
                       F.col("decoded").eqNullSafe(F.col("text")).alias("restored"))


RULES = [("net", "/", urls.BLOCK), ("example.net", "/en/", urls.ALLOW),
         ("example.com", "/de/", urls.BLOCK), ("org", "/fr/", urls.ALLOW)]


@query("""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(rule_host, rule_path, v) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(v, length(rule_host || rule_path)) AS v
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (page_id)
""")
def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict for every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labelled ones outside the test fold."""
    measured = materialize(quality.measure(table(spark, sf_dir, "documents")), "measured")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    scored = quality.scored(measured, quality.fit(measured, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS g FROM w, unnest(range(1, len(ws))) AS t(i)
  UNION SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g)
  WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(v, u) AS (
  SELECT a, b FROM both_ways UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON r.u = e.a),
low AS (SELECT v, min(u) AS u FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.u, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(low.u, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.v = d.doc_id
""")
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of word pairs are similar."""
    found = near.groups(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query("""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM w, unnest(range(1, len(ws) - 48)) AS t(i)),
low AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, i + o AS p FROM win JOIN low USING (k), unnest(range(50)) AS t(o) WHERE low < doc_id),
words AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (
  SELECT doc_id, count(gone.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (gone.p IS NULL), '') AS kept
  FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without passages of a smaller one."""
    return repeats.summaries(table(spark, sf_dir, "documents"))


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""")
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.where("vec_id % 100 = 0"), vectors, 10)


# Every user turn is a call of one tool, answered by the assistant turn after it; a call refers to the
# conversation's call two turns before, where there is one.
SCHEMAS = {"reply": {
    "properties": {"after": {"type": "object"}, "prompt": {"type": "string", "minLength": 1, "maxLength": 400},
                   "turn": {"type": "integer", "minimum": 0}},
    "required": ["prompt", "turn"], "additionalProperties": False}}


@query("""
WITH RECURSIVE u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
chain(conv_id, turn, depth) AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) FROM u
  WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
  UNION ALL SELECT u.conv_id, u.turn, depth + 1 FROM chain c JOIN u ON u.conv_id = c.conv_id AND u.turn = c.turn + 2),
a AS (SELECT conv_id, turn AS result_turn, text AS content FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, 'call-' || u.conv_id || '-' || u.turn AS call_id, u.turn, 'reply' AS name, depth,
  result_turn IS NOT NULL AS linked, result_turn,
  CASE WHEN length(text) > 400 THEN 'long prompt' WHEN length(text) < 1 THEN 'short prompt' ELSE '' END AS problems,
  '{"arguments":{' || CASE WHEN depth > 0
     THEN '"after":{"$ref":"call-' || u.conv_id || '-' || (u.turn - 2) || '"},' ELSE '' END
  || '"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || u.turn || '},"content":'
  || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"id":"call-' || u.conv_id || '-' || u.turn
  || '","name":"reply"}' AS message
FROM u JOIN chain USING (conv_id, turn) LEFT JOIN a ON a.conv_id = u.conv_id AND a.result_turn = u.turn + 1
UNION ALL
SELECT conv_id, 'call-' || conv_id || '-' || (result_turn - 1), NULL, NULL, NULL, false, result_turn, 'no call',
  '{"arguments":null,"content":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"id":"call-' || conv_id || '-'
  || (result_turn - 1) || '","name":null}'
FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = a.conv_id AND u.turn = a.result_turn - 1)
""")
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool-call messages of every conversation."""
    turns = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("call-"), "conv_id", F.lit("-"), turn)
    users = turns.where("role = 'user'").select("conv_id", "turn", "text")
    before = users.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("_has"))
    users = users.join(before, ["conv_id", "turn"], "left")
    after = F.when(F.col("_has"), F.struct(name(F.col("turn") - 2).alias("$ref")))
    calls = materialize(users.select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"),
        F.to_json(F.struct("turn", F.col("text").alias("prompt"), after.alias("after"))).alias("arguments")), "calls")
    results = turns.where("role = 'assistant'").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return chat.linked(calls, results, SCHEMAS).withColumn("problems", F.array_join("problems", ", "))


@query()
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the test fold."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()).select("text", "lang"))
    return langid.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("""
WITH h AS (
  SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS x, octet_length(encode(text)) AS b
  FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(x) AS a, unnest(range(1, b + 1)) AS i FROM h),
f AS (
  SELECT doc_id, i, a AS g1, lag(a) OVER w || a AS g2, lag(a, 2) OVER w || lag(a) OVER w || a AS g3,
    lag(a, 3) OVER w || lag(a, 2) OVER w || lag(a) OVER w || a AS g4,
    lag(a, 4) OVER w || lag(a, 3) OVER w || lag(a, 2) OVER w || lag(a) OVER w || a AS g5
  FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (
  SELECT doc_id, i, unnest([1, 2, 3, 4, 5]) AS n, unnest([g1, g2, g3, g4, g5]) AS gram FROM f),
c AS (SELECT gram, count(*) AS k FROM g WHERE gram IS NOT NULL GROUP BY gram),
best AS (
  SELECT doc_id, i, max(n) AS n, arg_max(gram, n) AS gram, arg_max(k, n) AS k
  FROM g JOIN c USING (gram) WHERE n = 1 OR k >= 2 GROUP BY doc_id, i),
logs AS (
  SELECT doc_id, ln(best.k / coalesce(c.k, (SELECT sum(b) FROM h))) + (least(5, i) - n) * ln(0.4) AS s
  FROM best LEFT JOIN c ON c.gram = left(best.gram, length(best.gram) - 2)),
per AS (SELECT doc_id, round(avg(s), 6) AS score FROM logs GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes, score
FROM documents LEFT JOIN per USING (doc_id)
""")
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log score of every document's bytes against counts of all documents."""
    return ngrams.score(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


@query("""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
e AS (SELECT doc_id, len(ws) AS b, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
f AS (
  SELECT doc_id, b, i, w AS g1, lag(w) OVER o || ' ' || w AS g2, lag(w, 2) OVER o || ' ' || lag(w) OVER o || ' ' || w AS g3
  FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, b, i, unnest([1, 2, 3]) AS n, unnest([g1, g2, g3]) AS gram FROM f),
own AS (SELECT doc_id, n, gram, count(*) AS k FROM g WHERE gram IS NOT NULL GROUP BY doc_id, n, gram),
other AS (SELECT doc_id, n, gram, sum(k) OVER (PARTITION BY n, gram) - k AS k FROM own),
p AS (SELECT doc_id, b, i, n, k FROM g JOIN other USING (doc_id, n, gram)),
best AS (
  SELECT p.doc_id, p.i, any_value(p.b) AS b, max(p.n) AS n, arg_max(p.k, p.n) AS k, arg_max(coalesce(c.k, -1), p.n) AS c
  FROM p LEFT JOIN p c ON c.doc_id = p.doc_id AND c.i = p.i - 1 AND c.n = p.n - 1
  WHERE p.n = 1 OR p.k > 0 GROUP BY p.doc_id, p.i),
logs AS (
  SELECT doc_id, (least(3, i) - n) * ln(0.4)
    + CASE WHEN n > 1 THEN ln(k / c) ELSE ln((k + 1) / ((SELECT sum(len(ws)) FROM d) - b + 1)) END AS s FROM best),
per AS (SELECT doc_id, round(avg(s), 6) AS score FROM logs GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, score FROM d LEFT JOIN per USING (doc_id)
""")
def op10_word_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log score of every document's words against counts of all other documents."""
    return wordgrams.score(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


@query()
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    return align.align(table(spark, sf_dir, "documents"))


@query("""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (
  SELECT *, cap / w AS ratio, sum(source_size) OVER () - sum(cap) OVER r + cap AS rest, sum(w) OVER () - sum(w) OVER r + w AS parts
  FROM s WINDOW r AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT rest, parts FROM o WHERE cap * parts >= w * rest ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT s.*, least(CAST(w * rest AS DOUBLE) / parts, CAST(cap AS DOUBLE)) AS target FROM s, level),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS z, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS before FROM d GROUP BY source, h)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN 2 * (target - whole * source_size - before) >= z THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN g ON g.source IS NOT DISTINCT FROM d.source AND g.h = d.h
""")
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix of all sources by weights takes of every document."""
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", F.col("targets")[0].alias("target"),
                      (F.col("size") * F.col("copies")[0]).alias("taken"))


@query("""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT doc_id, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM t),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) GROUP BY doc_id, term),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term),
m AS (SELECT doc_id, 10 + (90 * len(ws) * n_docs) // n_terms AS m FROM d, c WHERE len(ws) > 0),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""")
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
