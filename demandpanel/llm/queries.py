"""The operators' queries over the given tables, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, decontamination, exact_dedup, fingerprints, html_extraction, language_id, near_dedup, packing, sharding, spelling_variants, surrogates, url_filter, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


_BLANKS = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')"


@query("op1_exact_dedup", f"""
    WITH d AS (SELECT doc_id, sha256({_BLANKS}) AS h FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d""")
def op1(spark, folder):
    return exact_dedup.assign(read(spark, folder, "documents"))


@query("op2_sharding")
def op2(spark, folder):
    return sharding.assign(read(spark, folder, "documents"))


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""


@query("op8_minhash_near_dedup", f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2] FOR i IN range(1, len(w) - 1)])
        WHEN len(w) > 0 THEN [array_to_string(w, chr(31))] ELSE [] END AS sh FROM d),
    e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
    p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
        HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
    r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
    k AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, len(sh) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN k ON k.a = s.doc_id""")
def op8(spark, folder):
    return near_dedup.assign(read(spark, folder, "documents"), width=3, percent=85)


@query("op10_language_id")
def op10(spark, folder):
    docs = read(spark, folder, "documents")
    return language_id.identify(docs, language_id.train(docs))


@query("op3_decontamination")
def op3(spark, folder):
    return decontamination.find(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op5_packing")
def op5(spark, folder):
    return packing.pack(read(spark, folder, "documents"))


_ECHO = "</s>[INST] ok [/INST]"


@query("op6_chat_format", chat_format.digest_sql(f"""(SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{_ECHO}'), (-1, 1, 'assistant', '{_ECHO}')))"""))
def op6(spark, folder):
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{_ECHO}' AS text")
    return chat_format.read_back(chat_format.windows(rows.unionByName(more)))


@query("op4_url_filter", url_filter.judge_sql())
def op4(spark, folder):
    return url_filter.judge(read(spark, folder, "pages")).drop("score")


@query("op9_html_extraction")
def op9(spark, folder):
    pages = read(spark, folder, "pages")
    return html_extraction.extract(pages, html_extraction.train(pages))


@query("op7_pii_surrogates")
def op7(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return surrogates.rewritten(docs, b"corpus surrogates").select("doc_id", "text", F.size("_entities").alias("n_entities"), F.col("_entities").alias("entities"))


@query("op13_vector_codes", vector_codes.compress_sql())
def op13(spark, folder):
    return vector_codes.compress(read(spark, folder, "embeddings"))


@query("op12_fingerprints")
def op12(spark, folder):
    return fingerprints.compare_edited(read(spark, folder, "documents"))


@query("op11_spelling_variants", spelling_variants.variants_sql())
def op11(spark, folder):
    return spelling_variants.variants(read(spark, folder, "documents"))
