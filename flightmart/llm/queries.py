"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightmart.llm import brown, decontam, fingerprint, idfiles, langid, neardup, packing, pii, ranked, repeats, secret_scan, url_filter, variants
from flightmart.llm.common import read_table, scratch
from flightmart.llm.spans import base_spans, count_kind, span_text


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file; the folder is $FLIGHTMART_TOKENIZERS, or that of public_tokenizers."""
    if folder := os.environ.get("FLIGHTMART_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(read_table(spark, sf_dir, "documents"))


def op2_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return secret_scan.scan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", *[count_kind(spans, k).alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(span_text(base_spans(spans, secret_scan.BASE), secret_scan.KINDS), 256).alias("base_sha256"),
        span_text(spans, secret_scan.KINDS).alias("spans"))


def op3_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return pii.spans_by_row(read_table(spark, sf_dir, "documents")).select(
        "doc_id", *[count_kind(spans, k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(span_text(base_spans(spans, pii.BASE), pii.KINDS), 256).alias("base_sha256"), span_text(spans, pii.KINDS).alias("spans"))


def op6_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.scores(read_table(spark, sf_dir, "documents"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0)


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "idfiles")
    idfiles.write_ids(read_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return idfiles.read_ids(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


#: (action, host, path)
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op8_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.components(read_table(spark, sf_dir, "documents"), k=3, numerator=85, denominator=100)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = langid.fit(docs, learn=fold != 1)
    return langid.predict(docs, model).withColumn("held_out", F.coalesce(fold == 1, F.lit(False)))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_secret_spans": op2_secret_spans,
    "op3_benchmark_windows": op3_benchmark_windows,
    "op4_pack_sequences": op4_pack_sequences,
    "op5_personal_data": op5_personal_data,
    "op6_class_scores": op6_class_scores,
    "op7_id_files": op7_id_files,
    "op8_url_verdicts": op8_url_verdicts,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_language_id": op10_language_id,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_ranked_search": op12_ranked_search,
    "op13_repeated_passages": op13_repeated_passages,
}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op3_benchmark_windows": f"""
        WITH item AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
        doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
        win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i + 1:i + 10], ' ') AS run
                FROM item, unnest(range(greatest(len(w) - 10, 0) + 1)) AS r(i) WHERE len(w) > 0),
        grams AS (SELECT DISTINCT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS run
                  FROM doc, (SELECT DISTINCT n FROM win) AS k, unnest(range(len(w) - n + 1)) AS r(i) WHERE len(w) >= n),
        hit AS (SELECT doc_id, item_id, i, n FROM grams JOIN win USING (run, n)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) AS c GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) AS d GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_ranked_search": f"""
        WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents),
        size AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS l FROM doc WHERE len(w) > 0),
        m AS (SELECT r, doc_id, 100 - 75 + (75 * len(w)::BIGINT * nd) // l AS m FROM doc, size WHERE len(w) > 0),
        item AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM benchmark),
        asked AS (SELECT q, item_id, t, count(*) AS c FROM (SELECT q, item_id, unnest(w) AS t FROM item) AS i GROUP BY ALL),
        tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM doc) AS d WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
        wt AS (SELECT t, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY t),
        part AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS s FROM tf JOIN wt USING (t) JOIN m USING (r)),
        scored AS (SELECT q, item_id, doc_id, r, sum(c * s)::BIGINT AS score FROM asked JOIN part USING (t) GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_repeated_passages": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
        w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, unnest(range(n - 49)) AS t(i) WHERE n >= 50),
        first AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
        hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM w JOIN first USING (s) WHERE doc_id > least),
        numbered AS (SELECT r, i, sum(CASE WHEN i <= p + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM hit),
        run AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY r, g),
        piece AS (SELECT r, a, substr(h, 2 * lo + 1, 2 * (a - lo)) AS s
                  FROM (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS lo FROM (SELECT r, a, b FROM run UNION ALL SELECT r, n, n FROM d) AS e) AS x JOIN d USING (r)),
        kept AS (SELECT r, string_agg(s, '' ORDER BY a, length(s) DESC) AS k FROM piece GROUP BY r),
        removed AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM run GROUP BY r)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
        FROM d JOIN kept USING (r) LEFT JOIN removed USING (r)""",
}
