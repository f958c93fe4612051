"""The registered queries opN_<name>, with production parameters over whole tables,
and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.llm.common import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


# Rules of the contract (fixed values).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first; else a page is blocked when its canonical URL is listed: the list
    holds every canonical URL seen on a junk site (`JUNK_HOST`), and grows with the pages."""
    from leadflow.llm import url_filter as u
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = u.canonical(F.col("url"))
    listed = pages.select(host.alias("host"), path.alias("path")).filter(F.col("host").rlike(JUNK_HOST))
    return u.url_filter(pages, [u.Rule(*r) for r in URL_RULES], listed)


# Site names with one of these words between hyphens are junk (fixed values of the list's rule).
JUNK_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")
#: A host whose third label from the right, its site's name, holds one of them.
JUNK_HOST = r"(^|\.)([^.]*-)?(" + "|".join(JUNK_WORDS) + r")(-[^.]*)?\.[^.]+\.[^.]+$"


ORACLE["op1_url_filter"] = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES """ + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES) + r"""),
u AS (SELECT row_number() OVER () AS rid, page_id,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host0 FROM u),
c AS (SELECT rid, page_id, translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(host0) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT rid, arg_max(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) AS best
      FROM c JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid),
listed AS (SELECT DISTINCT host, path, true AS listed FROM c WHERE regexp_matches(host, '""" + JUNK_HOST + r"""'))
SELECT page_id, host, path, best.rule AS rule, coalesce(listed, false) AS listed,
       coalesce(best.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN m USING (rid) LEFT JOIN listed USING (host, path)"""


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.simhash import simhash_components
    return simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.quality import quality_rules
    return quality_rules(table(spark, sf_dir, "documents")).drop("lang", "source")


def _model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.piece_codec import digests
    return digests(table(spark, sf_dir, "documents"), _model())


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.piece_count import token_counts
    return token_counts(table(spark, sf_dir, "documents"), _model())


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.langid import language_id
    return language_id(table(spark, sf_dir, "documents"), modulus=5, remainder=0)


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents"))


@query
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.embed_dedup import embedding_dedup
    return embedding_dedup(table(spark, sf_dir, "embeddings"), cosine=0.98)


ORACLE["op8_embedding_dedup"] = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
        AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b, a.vec_id AS va, b.vec_id AS vb FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
        AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT va, vb FROM l UNION SELECT reach.a, l.vb FROM reach JOIN l ON reach.b = l.va),
c AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(c.m, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(c.m, v.vec_id)) AS kept
FROM v LEFT JOIN n USING (r) LEFT JOIN c ON c.vec_id = v.vec_id"""


@query
def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.lm import lm_scores
    return lm_scores(table(spark, sf_dir, "documents"), modulus=7, remainder=2)


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm import chat
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(chat.PROBE_ID).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(chat.PROBE_TEXT).alias("text"))
        for i, role in enumerate(("user", "assistant"))])))
    return chat.read_back(stored(chat.packs(rows.unionByName(probe)), "chat-packs"))


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.exact_dedup import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE["op11_exact_dedup"] = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT r, doc_id, length(text) AS n, sha256(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM t),
p AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM k WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM p"""


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.fim import fill_in_middle, restored
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed=42, fim_percent=50, spm_percent=80)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE["op12_fill_in_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
        CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
        CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(tokens[1:a], '') AS pre, array_to_string(tokens[a + 1:b], '') AS mid, array_to_string(tokens[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM f"""


@query
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.importance import resample
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)


# The bytes of a feature go through the usual table of 256 remainders, made here by its rule.
ORACLE["op13_importance"] = r"""
WITH crc_table AS (SELECT list(r ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS r FROM range(256) x(i))),
texts AS (SELECT 'd' AS side, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark),
w AS (SELECT side, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM w WHERE len(w) > 0),
g AS MATERIALIZED (SELECT side, r, feature, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM g)),
k AS MATERIALIZED (SELECT feature, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM h, crc_table),
s AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM g JOIN k USING (feature) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(s.t, 0) AS DOUBLE) + 1) * (CAST(tot.s AS DOUBLE) + 10000)
        / ((CAST(coalesce(s.s, 0) AS DOUBLE) + 1) * (CAST(tot.t AS DOUBLE) + 10000)))) AS BIGINT) AS gain
        FROM s, (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM s) tot),
m AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
      FROM g JOIN k USING (feature) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
d AS (SELECT row_number() OVER () AS r, doc_id, CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM documents),
z AS (SELECT r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(n_features, 0) >= 39 AS able,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) OVER (PARTITION BY able) AS total FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * total // 100 THEN place END AS rank FROM o"""
