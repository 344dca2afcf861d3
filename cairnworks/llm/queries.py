"""Queries over the intended tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnworks.llm import bpe, centroids, decontaminate, exact_dedup, extract, langid, line_dedup, packing, pii, simhash_dedup, tokens, vector_codes, warc

#: The tokenizer that the contracts of op1, op6 and op13 name.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are of base spans, as base_sha256 is; ``spans`` has what the patterns add too."""
    found = pii.personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        *[pii.counted("base", kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.listed("base"), 256).alias("base_sha256"),
        pii.listed("spans").alias("spans"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        decontaminate.item_digest().alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = vector_codes.with_label_error(rows).select("vec_id", "code", "error", "label_error")
    return found.withColumn("codebooks_sha256", F.lit(vector_codes.books_digest(books)))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.decode(bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER), TOKENIZER)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_pii": op2_pii,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_vector_codes": op12_vector_codes,
    "op13_bpe": op13_bpe,
    "pipeline": pipeline,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = "regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The floor of a quotient of whole numbers.
_FLOOR = "CAST(({s} - ((({s}) % {n}) + {n}) % {n}) // {n} AS BIGINT)"


def _clustering_sql(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds, each a common table expression; a row for each component."""
    parts = [
        """WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
        v AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS j, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept)""",
        f"""drawn AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k}),
        c0 AS MATERIALIZED (SELECT c, j, x FROM drawn JOIN v USING (vec_id))""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT vec_id, c, CAST(sum((v.x - k.x) * (v.x - k.x)) AS BIGINT) AS d FROM v JOIN c{r} k USING (j) GROUP BY vec_id, c)
          QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT k.c, k.j, coalesce(m.x, k.x) AS x FROM c{r} k LEFT JOIN
              (SELECT c, j, {_FLOOR.format(s="sum(x)", n="count(*)")} AS x FROM a{r} JOIN v USING (vec_id) GROUP BY c, j) m ON m.c = k.c AND m.j = k.j)""")
    return ", ".join(parts) + f"""
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
          (SELECT sha256(string_agg(x, ',' ORDER BY j)) FROM c{rounds} k WHERE k.c = a.c) AS centroid_sha256 FROM a{rounds} a"""


def _codes_sql(rounds: int = 6) -> str:
    """Codebooks by part p, entry e and position j within the part."""
    parts = [
        """WITH kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
        u AS (SELECT vec_id, unnest(range(64)) AS i, CAST(floor(4096 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
        v AS MATERIALIZED (SELECT vec_id, i // 8 AS p, i % 8 AS j, x FROM u)""",
        """first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 16),
        b0 AS MATERIALIZED (SELECT p, e, j, x FROM first JOIN v USING (vec_id))""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, e, d FROM (SELECT vec_id, v.p, e, CAST(sum((v.x - k.x) * (v.x - k.x)) AS BIGINT) AS d FROM v JOIN b{r} k ON k.p = v.p AND k.j = v.j GROUP BY vec_id, v.p, e)
          QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)""")
        if r < rounds:
            parts.append(f"""b{r + 1} AS MATERIALIZED (SELECT k.p, k.e, k.j, coalesce(m.x, k.x) AS x FROM b{r} k LEFT JOIN
              (SELECT a.p, e, j, {_FLOOR.format(s="sum(x)", n="count(*)")} AS x FROM a{r} a JOIN v ON v.vec_id = a.vec_id AND v.p = a.p GROUP BY a.p, e, j) m ON m.p = k.p AND m.e = k.e AND m.j = k.j)""")
    return ", ".join(parts) + f""",
        coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(x, ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


ORACLES = {
    "op11_centroid_clustering": _clustering_sql(),
    "op12_vector_codes": _codes_sql(),
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        h AS (SELECT page_id, body, array_to_string(list_transform(string_split(sha1(body), ''),
                lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS b,
                min(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + 16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT)
                   + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT) + CAST(substr(b, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h""",
    "op4_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
        iw AS (SELECT id, least(13, len(ws)) AS k, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda x: array_to_string(ws[x:x + 12], ' '))) AS win FROM i WHERE len(ws) > 0),
        ks AS (SELECT DISTINCT k FROM iw),
        s AS (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS pos FROM d, ks WHERE len(ws) >= k),
        dw AS (SELECT doc_id, k, pos, array_to_string(ws[pos:pos + k - 1], ' ') AS win FROM s),
        m AS (SELECT dw.doc_id, dw.k, dw.pos, iw.id FROM dw JOIN iw ON iw.k = dw.k AND iw.win = dw.win),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM m) GROUP BY doc_id),
        it AS (SELECT doc_id, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM m GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op7_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM d),
        k AS (SELECT doc_id, pos, line,
                     translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT k.doc_id, k.pos, k.line, (f.key IS NOT NULL AND k.doc_id <> f.owner) AS dropped FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op9_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_FOLD} AS txt FROM documents),
        g AS (SELECT txt, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY txt)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(txt) AS text_sha256 FROM t JOIN g USING (txt)""",
}
