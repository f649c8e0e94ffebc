"""The registered queries of this subpackage, and SQL where SQL can express one on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, dialogue, langid, minhash, mixing, quality, ranking, rules, shuffle, suffixdedup, topk, trainorder, urlfilter
from .storage import table

N_SHARDS = 40


def _remainder(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(_remainder(5) != 0))
    scores = quality.scored(docs, model)
    return scores.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence with its place, in ranges of whole shards; ``trainorder.write_shards`` puts the same rows into files."""
    return trainorder.training_order(table(spark, sf_dir, "documents"))


def op3_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_remainder(4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.norm_bucket_topk(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = shuffle.external_shuffle(table(spark, sf_dir, "documents"), N_SHARDS)
    return moved.select(
        "doc_id",
        shuffle.record_size("text").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.col("_grown_shard").alias("grown_shard"),
    )


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.pareto_mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


def op8_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op11_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).drop("failed_rule")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of conversation and turn; a dropped row is marked ``gone``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("fault", F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(blank("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), F.explode(copies).alias("copy"))


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_conversations(damaged(table(spark, sf_dir, "conversations")), gone="gone")


def op13_shared_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    f.__name__: f
    for f in (
        op1_bradley_terry, op2_training_order, op3_string_kernel, op4_norm_bucket_topk, op5_external_shuffle, op6_pareto_mix,
        op7_simhash_windows, op8_url_sweep, op9_suffix_merge, op10_superminhash, op11_rule_cascade,
        op12_dialogue_repair, op13_shared_ranking,
    )
}

ORACLE_SQL = {
    "op4_norm_bucket_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op8_url_sweep": r"""
WITH rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), f AS (
  SELECT page_id, host, path, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS n
  FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM f WHERE n = 1
""",
    "op11_rule_cascade": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents
), w AS (
  SELECT rid, unnest(l) AS w, unnest(range(len(l))) AS i
  FROM (SELECT rid, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS l FROM d)
), runs AS (
  SELECT *, lead(w, 4) OVER o IS NOT NULL AS five, lead(w, 2) OVER o IS NOT NULL AS three,
         concat_ws(' ', w, lead(w) OVER o, lead(w, 2) OVER o) AS w3,
         concat_ws(' ', w, lead(w) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS w5
  FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)
), again AS (
  SELECT *, five AND count(*) OVER (PARTITION BY rid, five, w5) > 1 AS twice FROM runs
), covered AS (
  SELECT *, max(twice::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM again
), words AS (
  SELECT rid, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, sum(covered)::BIGINT AS n_repeat_words,
         count(*) FILTER (regexp_matches(w, '[A-Z].*[A-Z]') AND NOT regexp_matches(w, '[a-z]')) AS loud,
         count(*) FILTER (NOT regexp_matches(w, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')) AS letterless
  FROM covered GROUP BY rid
), triples AS (
  SELECT rid, max(n) AS triple FROM (SELECT rid, count(*) AS n FROM runs WHERE three GROUP BY rid, w3) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*(-|\*|•)')) AS bullets,
         count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS cut
  FROM (SELECT rid, unnest(string_split(x, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), f AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, loud, letterless, coalesce(triple, 0) AS triple, n_lines, bullets, cut
  FROM d LEFT JOIN words USING (rid) LEFT JOIN triples USING (rid) LEFT JOIN lines USING (rid)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 10 * loud > 3 * n_words OR 10 * letterless > 3 * n_words
            OR 10 * bullets > 9 * n_lines OR 10 * cut > 3 * n_lines OR (triple >= 3 AND 15 * triple > n_words)) AS kept
FROM b
""",
    "op12_dialogue_repair": r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''),
           lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT) % 20 AS fault FROM keyed
), rows_ AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM rows_
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), faulty AS (
  SELECT conv_id, turn, role, text, i, n, before, left(role, 1) AS kind, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM seen
), moved AS (
  -- what each state may do with the row: the states are nothing yet, after s, after u, after a
  SELECT *, fault IN ('blank', 'duplicate') AS must_go, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS broken,
         CASE kind WHEN 's' THEN [2, NULL, NULL, NULL] WHEN 'u' THEN [3, 3, NULL, 3] WHEN 'a' THEN [NULL, NULL, 4, NULL] ELSE [NULL, NULL, NULL, NULL] END AS keeps FROM faulty
), way AS (
  SELECT conv_id, n AS i, [{'c': 0, 'a': '', 't': ''}, {'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'}, {'c': 0, 'a': '', 't': ''}] AS s
  FROM moved WHERE i = n
  UNION ALL
  SELECT conv_id, i - 1, list_transform([1, 2, 3, 4], lambda q: list_sort([b[q],
           {'c': 3 + b[[3, 3, 4, 3][q]].c, 'a': 'I' || b[[3, 3, 4, 3][q]].a, 't': chr(10) || ['user:', 'user:', 'assistant:', 'user:'][q] || b[[3, 3, 4, 3][q]].t},
           {'c': 6 + b[[4, 4, 3, 4][q]].c, 'a': 'II' || b[[4, 4, 3, 4][q]].a, 't': chr(10) || ['user:', 'user:', 'assistant:', 'user:'][q] || chr(10) || ['assistant:', 'assistant:', 'user:', 'assistant:'][q] || b[[4, 4, 3, 4][q]].t}])[1])
  FROM (SELECT w.conv_id, w.i, list_transform([1, 2, 3, 4], lambda q: list_sort(list_filter([
           {'c': 4 + s[q].c, 'a': 'D' || s[q].a, 't': s[q].t},
           CASE WHEN NOT must_go AND keeps[q] IS NOT NULL THEN {'c': broken + s[keeps[q]].c, 'a': 'K' || s[keeps[q]].a, 't': chr(10) || role || ':' || text || s[keeps[q]].t} END,
           CASE WHEN NOT must_go THEN {'c': 3 + broken + s[[3, 3, 4, 3][q]].c, 'a': 'R' || s[[3, 3, 4, 3][q]].a, 't': chr(10) || ['user:', 'user:', 'assistant:', 'user:'][q] || text || s[[3, 3, 4, 3][q]].t} END],
           lambda x: x IS NOT NULL))[1]) AS b
        FROM way w JOIN moved m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i)
), counted AS (
  SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || kind NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(s[1].c, 0)::BIGINT AS cost, coalesce(s[1].a, '') AS audit, sha256(coalesce(s[1].t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN way w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.i = 0
""",
    "op13_shared_ranking": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents
), q AS (
  SELECT row_number() OVER () AS iid, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM benchmark
), s AS (
  SELECT count(*)::BIGINT AS docs, sum(len(l))::BIGINT AS length FROM d WHERE len(l) > 0
), tf AS (
  SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(l) AS t FROM d) GROUP BY ALL
), w AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, docs
), m AS (
  SELECT rid, doc_id, 25 + (75 * len(l) * docs) // length AS m FROM d, s WHERE len(l) > 0
), c AS (
  SELECT rid, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS c FROM tf JOIN w USING (t) JOIN m USING (rid)
), i AS (
  SELECT iid, item_id, t, count(*) AS times FROM (SELECT iid, item_id, unnest(l) AS t FROM q) GROUP BY ALL
), r AS (
  SELECT iid, item_id, doc_id, sum(times * c)::BIGINT AS score FROM i JOIN c USING (t) GROUP BY iid, item_id, rid, doc_id
), n AS (
  SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM n WHERE rank <= 10
""",
}
