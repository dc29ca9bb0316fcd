"""One query for each operator, over its whole table with production parameters, and the SQL that checks it where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selenogrid.llm import divergence, grading, infill, mixing, neighbours, packing, quality, secrets, shards, simhash, tokenfiles, tokens, toxicity
from selenogrid.llm.base import table, word_count
from selenogrid.session import work_folder, write_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


@query("op1_simhash_near_dedup")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op5_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: The CRC-32 of each text's bytes, one look-up of its 256 remainders a byte.
SHARDS_SQL = """
WITH RECURSIVE b(i, k, r) AS (SELECT i, 0, i FROM range(256) AS t(i) UNION ALL SELECT i, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM b WHERE k < 8),
crc AS MATERIALIZED (SELECT list(r ORDER BY i) AS r FROM b WHERE k = 8),
d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size, hex(encode(coalesce(text, ''))) AS x,
             ('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
e AS (SELECT doc_id, source, size, h, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 8), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
             lambda c, y: xor(c >> 8, crc.r[(xor(c, y) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1 AS r, count(*) OVER (PARTITION BY source) AS c FROM e),
g AS (SELECT *, row_number() OVER (ORDER BY (r + 0.5::DOUBLE) / c, source NULLS FIRST, h, doc_id NULLS FIRST, text_crc32, size) - 1 AS g, count(*) OVER () AS n FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(g * 24 // n AS INTEGER) AS shard,
       CAST(g - ((g * 24 // n) * n + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM g
"""


@query("op6_stratified_shards", SHARDS_SQL)
def stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.interleave(table(spark, sf_dir, "documents"), 24).drop("source")


#: Domains of the sources of the test tables, and the shares that a mixture aims at, by level of the tree.
DOMAINS = {"web": range(0, 5), "books": range(5, 10), "forums": range(10, 15), "papers": range(15, 20)}
WEIGHTS = {"domain": {"web": 4.0, "books": 3.0, "forums": 1.0, "papers": 2.0}, "lang": {"en": 6.0, "de": 2.0, "fr": 2.0, "es": 1.0}}
SHARE, EPOCHS, SEED = 0.6, 4, 42


def with_domain(docs: DataFrame) -> DataFrame:
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"^src(\d{1,9})$", 1)
    domain = F.lit("other")
    for name, span in DOMAINS.items():
        domain = F.when(number.isin([str(i) for i in span]), name).otherwise(domain)
    return docs.withColumn("domain", domain)


def _fill_sql(level: str, path: list[str], given: str, weights: dict[str, float]) -> str:
    """One level of sharing out, as SQL: the CTE g_<level> with the levels of ``path`` and given."""
    keys, up = ", ".join(path), ", ".join(path[:-1])
    weight = "CASE " + " ".join(f"WHEN n.{level} = '{v}' THEN {w}::DOUBLE" for v, w in weights.items()) + " ELSE 1::DOUBLE END" if weights else "1::DOUBLE"
    on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM p.{c}" for c in path[:-1]) or "true"
    by = f"PARTITION BY {up}" if up else ""
    return f"""
n_{level} AS (SELECT {keys}, sum(tokens::DOUBLE * {EPOCHS}) AS room FROM leaves GROUP BY {keys}),
w_{level} AS (SELECT n.*, p.given, {weight} AS weight FROM n_{level} n JOIN {given} p ON {on}),
r_{level} AS (SELECT *, room / weight AS fills_at,
    (given - coalesce(sum(room) OVER ({by} ORDER BY room / weight, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(weight) OVER ({by} ORDER BY room / weight, {level} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w_{level}),
g_{level} AS (SELECT {keys}, CASE WHEN fills_at > rate THEN weight * max(CASE WHEN fills_at > rate THEN rate END) OVER ({by or ''}) ELSE room END AS given FROM r_{level})"""


_DOMAIN_SQL = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(f'src{i}') for i in span)}) THEN '{name}'" for name, span in DOMAINS.items()) + " ELSE 'other' END"
MIX_SQL = f"""
WITH t AS (SELECT doc_id, lang, source, {_DOMAIN_SQL} AS domain, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY ALL),
g_root AS (SELECT sum(tokens) * {SHARE}::DOUBLE AS given FROM leaves),
{_fill_sql("domain", ["domain"], "g_root", WEIGHTS["domain"])},
{_fill_sql("lang", ["domain", "lang"], "g_domain", WEIGHTS["lang"])},
{_fill_sql("source", ["domain", "lang", "source"], "g_lang", {})},
b AS (SELECT l.*, floor(g.given + 1e-6)::BIGINT AS budget FROM leaves l JOIN g_source g
      ON l.domain IS NOT DISTINCT FROM g.domain AND l.lang IS NOT DISTINCT FROM g.lang AND l.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM b),
o AS (SELECT t.*, q.whole, q.budget - q.whole * q.tokens AS rest,
             ('0x' || substr(md5('{SEED}|' || q.whole || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
      FROM t JOIN q ON t.domain IS NOT DISTINCT FROM q.domain AND t.lang IS NOT DISTINCT FROM q.lang AND t.source IS NOT DISTINCT FROM q.source),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM o)
SELECT doc_id, domain, lang, source, CAST(unnest(range(whole + CASE WHEN rest > 0 AND so_far <= rest THEN 1 ELSE 0 END)) AS INTEGER) AS epoch FROM s
"""


@query("op2_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents"))
    leaves = mixing.plan(docs, mixing.LEVELS, WEIGHTS, SHARE, EPOCHS, SEED)
    return mixing.mix(docs.select("doc_id", "domain", "lang", "source"), leaves, mixing.LEVELS, SEED)


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS i FROM documents),
g AS (SELECT i, p, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS x(p)),
c AS (SELECT i, p FROM (SELECT i, p, count(*) OVER (PARTITION BY i, g) AS n FROM g) WHERE n > 1),
m AS (SELECT i, CAST(count(DISTINCT p + k) AS BIGINT) AS n_repeat_words FROM c, range(5) AS y(k) GROUP BY i),
l AS (SELECT i, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT i, unnest(string_split(t, chr(10))) AS x FROM d)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY i),
s AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'gs')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN m USING (i) LEFT JOIN l USING (i)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 50 * n_lines AS failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE failed) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT sum(n) AS n, sum(k) AS k, count(*) AS hosts, sum(k * k / n::DOUBLE) AS squares FROM h),
p AS (SELECT k / n::DOUBLE AS mean, (k / n::DOUBLE) * (1 - k / n::DOUBLE) AS spread, squares / n - (k / n::DOUBLE) * (k / n::DOUBLE) AS had, hosts / n::DOUBLE AS part FROM a),
q AS (SELECT mean, CASE WHEN had - spread * part > 0 AND spread > 0 THEN least(greatest(spread / (had - spread * part) - 1, 1), 1e6) ELSE 1e6 END AS weight FROM p),
r AS (SELECT source AS host, (k + mean * weight) / (n + weight) AS rate, mean, 1 * sqrt(mean * (1 - mean) / (weight + 1)) AS off FROM h, q),
v AS (SELECT host, rate > 0.5 AS rejected, rate < mean - off AS trusted FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AND (NOT failed OR coalesce(trusted, false)) AS kept
FROM f LEFT JOIN v ON f.source = v.host
"""


@query("op3_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = write_table(quality.document_stats(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"), "quality")
    return quality.judge(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_pack_lengths")
def pack_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_count("text"))


@query("op7_ordinal_quality")
def ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # three grades: poor, good but toxic, good
    clean = 1 - F.coalesce(F.col("toxic"), F.lit(0))
    ratings = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * (1 + clean)).alias("grade"))
    return grading.grades(docs, *grading.train(docs, ratings))


@query("op8_toxicity")
def toxic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.character_model(docs)
    return toxicity.scores(docs, model, toxicity.train(docs, table(spark, sf_dir, "labels"), model))


@query("op10_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


NEAR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""


@query("op9_embedding_near_dedup", NEAR_SQL)
def embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


INFILL_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
                  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, t, w, len(w) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(w) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(w) + 1) AS b,
             ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS d FROM t),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain' WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form,
             coalesce(array_to_string(list_slice(w, 1, least(a, b)), ''), '') AS x, coalesce(array_to_string(list_slice(w, least(a, b) + 1, greatest(a, b)), ''), '') AS y,
             coalesce(array_to_string(list_slice(w, greatest(a, b) + 1, n), ''), '') AS z FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""


@query("op11_fill_in_middle", INFILL_SQL)
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restore("output", "form"), 256).alias("restored_sha256"))


@query("op12_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_folder(spark)}/selenogrid/token-files-{uuid.uuid4().hex[:12]}"
    tokenfiles.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end=2)
    return tokenfiles.checksums(tokenfiles.documents(spark, folder))


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)),
s AS (SELECT g.lang, g.source, g.v, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v)::HUGEINT AS p FROM s JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM p GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b USING (lang) WHERE a.source <> b.source AND a.v = 0),
more AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM more))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""


@query("op13_source_divergence", DIVERGENCE_SQL)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
