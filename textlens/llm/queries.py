"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embed_dedup, langid, licenses, line_dedup, ngram_join, oracles, pieces, pii, quality, resample, sharding, url_filter, vector_codes
from .common import cut, table

#: A public vocabulary, read by the driver; a parameter of the operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_sites=8).select("doc_id", "n_lines", "n_removed", "text")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 16)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(quality.with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")))
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("y"))
    test = langid.held_out("doc_id", 5, 0)
    model = quality.fit(stats.join(labels, "doc_id").where(~test))
    scored = quality.score(stats, model)
    return scored.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    test = langid.held_out("doc_id", 4, 2)
    prototypes = langid.train_prototypes(docs.where(~test).select("lang", "text"))
    found = langid.identify(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", test.alias("held_out"), "lang_pred", "score")


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), model)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_links(table(spark, sf_dir, "documents"), 0.8)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, min_words=20, seed=2024)


URL_RULES = [url_filter.Rule(*r) for r in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict")


_SHINGLES = r"""list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' ')))"""
_WORDS = r"""list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"""

OP2_SQL = """WITH lines AS (SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)),
spread AS (SELECT trim(line) AS k, min(doc_id) AS first FROM lines WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 8),
marked AS (SELECT lines.*, k IS NOT NULL AND first <> doc_id AS gone FROM lines LEFT JOIN spread ON trim(line) = k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id"""

OP5_SQL = f"""WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, 5 AS width, unnest({_SHINGLES}) AS s FROM iw WHERE len(w) >= 5 UNION ALL SELECT item_id, len(w), array_to_string(w, ' ') FROM iw WHERE len(w) BETWEEN 1 AND 4),
short AS (SELECT DISTINCT width FROM i WHERE width < 5),
d AS (SELECT doc_id, 5 AS width, unnest({_SHINGLES}) AS s FROM dw WHERE len(w) >= 5
UNION ALL SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda j: array_to_string(w[j:j + width - 1], ' '))) FROM dw JOIN short ON len(w) >= width),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment FROM d JOIN i USING (width, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= n_item * 0.8 - 1e-9"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": OP2_SQL, "op5_decontamination": OP5_SQL, "op11_vector_codes": oracles.vector_codes(),
        "op12_importance_resampling": oracles.importance_resampling(), "op13_url_filter": oracles.url_filter(URL_RULES),
    }


def queries() -> dict:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_line_dedup, op3_quality, op4_personal_data, op5_decontamination, op6_sharding, op7_language_id, op8_sentencepiece, op9_license_scan, op10_ngram_jaccard_join, op11_vector_codes, op12_importance_resampling, op13_url_filter)}
