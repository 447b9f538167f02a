"""The operators' queries over whole tables, and SQL for those that DuckDB can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitflow.llm import bpe, decontam, embed_dedup, filter_audit, langid, licenses, minhash, pii, quality, resample, revisit, substring_dedup, suffix_dedup

#: Where the vocabulary lies; a parameter of ``op8_byte_bpe``.
RANKS = "byte_bpe_multi_50k.tiktoken"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "text")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", "text_score", "meta_score", "score", "kept")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(documents(spark, sf_dir), least=85)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)
    counts = [F.size(pii.of_kind("base", k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(documents(spark, sf_dir))


def op8_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.Vocabulary(spark, ranks or public_tokenizers.path(RANKS))
    return bpe.digests(documents(spark, sf_dir).select("doc_id", "text"), vocabulary).drop("text")


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisit.resolve(revisit.captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    pairs = F.transform(F.map_entries("headers"), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return found.withColumn("headers", F.when(F.col("headers").isNotNull(), F.array_join(F.array_sort(pairs), ";")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    filters = langid.train(docs.where(~F.coalesce(held, F.lit(False))).select("text", "lang"))
    rows = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    return langid.predict(rows, filters)


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "text")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality": op2_quality,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_licenses": op7_licenses,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_language": op10_language,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_importance_resampling": op13_importance_resampling,
}

_REACH = """reach AS (
  SELECT id AS a, id AS b FROM nodes
  UNION
  SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), classes AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FEATURES = "unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))"

ORACLES: dict[str, str] = {
    "op3_embedding_near_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
  SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.label = y.label AND x.id < y.id
  WHERE list_dot_product(x.e, x.e) > 0 AND list_dot_product(y.e, y.e) > 0 AND list_cosine_similarity(x.e, y.e) >= 0.98
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT e.vec_id, (SELECT count(*) FROM both_ways w WHERE w.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN classes c ON e.vec_id = c.id
""",
    "op4_minhash_near_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
both_of AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_of JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN classes c ON d.doc_id = c.id LEFT JOIN n ON n.id = d.doc_id
""",
    "op9_warc_revisits": r"""
WITH a0 AS (
  SELECT page_id AS n, page_id % 3 < 2 AS shared, CASE WHEN page_id % 3 = 0 THEN 'hot.example/all' ELSE 'site' || (page_id % 97) || '.example/p' END AS host,
         url AS own_url, md5(coalesce(html, '')) AS own, (page_id * 7 + page_id // 10) % 10 AS c, page_id + page_id * 7919 % 120 AS asked FROM pages
), a1 AS (
  SELECT *, CASE WHEN shared THEN CASE n % 4 WHEN 0 THEN 'http://' || host WHEN 1 THEN 'HTTPS://www.' || host || '/' WHEN 2 THEN host || '?utm_source=p' ELSE 'https://u@' || host || '?ref=a#top' END ELSE own_url END AS url,
         CASE WHEN shared THEN 'v' || (n // 40) ELSE substr(own, 1, 16) END AS v, CASE WHEN shared THEN 'v' || (asked // 40) ELSE substr(own, 1, 16) END AS asked_v FROM a0
), a AS (
  SELECT *, regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM a1
), b AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www\.', '') AS site,
         regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         regexp_replace(regexp_replace('&' || regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') AS q FROM a
), p AS (SELECT *, site || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS u FROM b), r AS (
  SELECT n * 2 + 1 AS record_id, u, asked * 10 + 5 AS ts, n, CASE WHEN c = 2 THEN '"other"' WHEN c NOT BETWEEN 4 AND 8 THEN 'W/"' || asked_v || '"' END AS own_tag,
         CASE WHEN c IN (4, 5) THEN asked_v END AS own_lm, CASE WHEN c IN (7, 8) THEN md5(asked_v) END AS own_digest FROM p
), f AS (SELECT n * 2 AS fid, u, n * 10 AS fts, '"' || v || '"' AS tag, v AS lm, md5(v) AS digest FROM p WHERE c >= 2),
m AS (SELECT r.*, f.fid, f.tag, f.lm, f.digest FROM r ASOF LEFT JOIN f ON r.u = f.u AND r.ts >= f.fts),
s AS (
  SELECT *, CASE WHEN fid IS NULL THEN 'unresolved'
                 WHEN own_tag IS NOT NULL THEN CASE WHEN regexp_replace(own_tag, '^W/', '') = tag THEN 'resolved' ELSE 'changed' END
                 WHEN own_lm IS NOT NULL THEN CASE WHEN own_lm = lm THEN 'resolved' ELSE 'changed' END
                 WHEN own_digest IS NOT NULL THEN CASE WHEN own_digest = digest THEN 'resolved' ELSE 'changed' END
                 ELSE 'unverified' END AS state FROM m
)
SELECT record_id, u AS canonical_url, ts, fid AS response_id, state,
       CASE WHEN state = 'resolved' THEN 'content-type=text/html;date=r' || n || ';etag=' || coalesce(own_tag, tag) || ';last-modified=' || lm END AS headers
FROM s
""",
    "op11_filter_interactions": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), n AS (SELECT part, mask, good, toxic, count(*) AS n FROM f GROUP BY ALL),
grown AS (SELECT '' AS o UNION ALL SELECT o || x FROM grown, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
orders AS (SELECT o AS filter_order, k::INTEGER AS step, list_sum(list_transform(range(1, k), lambda j: 1 << (instr('ABCDE', o[j]) - 1))) AS before, 1 << (instr('ABCDE', o[k]) - 1) AS own FROM grown, range(1, 6) t(k) WHERE length(o) = 5),
steps AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN mask & (coalesce(before, 0)::INTEGER | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0)::INTEGER = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0)::INTEGER <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0)::INTEGER = 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0)::INTEGER = 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM n, orders GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM steps
""",
    "op12_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), runs AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS run FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
later AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY run) AS lo FROM runs) WHERE lo < doc_id),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM later),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256, coalesce(text, '') AS text FROM d LEFT JOIN kept USING (r)
""",
    "op13_importance_resampling": rf"""
WITH RECURSIVE turn AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM turn WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS turned FROM turn WHERE k = 8), orders AS (SELECT k FROM range(1, 4) t(k)),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({_LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT list_filter(regexp_split_to_array({_LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
own AS (SELECT r, f, count(*) AS m FROM (SELECT r, {_FEATURES} AS f FROM d, orders WHERE len(w) >= k) GROUP BY r, f),
aims AS (SELECT f, count(*) AS m FROM (SELECT {_FEATURES} AS f FROM b, orders WHERE len(w) >= k) GROUP BY f),
placed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: (instr('123456789ABCDEF', x[2 * i + 1]) * 16 + instr('123456789ABCDEF', x[2 * i + 2]))::BIGINT),
                lambda c, y: xor(c >> 8, turned[(xor(c, y) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM own UNION SELECT f FROM aims)), crc
), s AS (SELECT bucket, sum(m) AS s FROM own JOIN placed USING (f) GROUP BY bucket), t AS (SELECT bucket, sum(m) AS t FROM aims JOIN placed USING (f) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS all_s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS all_t),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000) / ((s::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT r, sum(m)::BIGINT AS n_features, sum(m * gain)::BIGINT AS weight FROM own JOIN placed USING (f) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)
), ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS n, count(*) OVER () AS n_all FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN n <= 5 * n_all // 100 THEN n END AS rank FROM scored LEFT JOIN ranked USING (r)
""",
}
