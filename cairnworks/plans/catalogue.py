"""Registered queries over the driver's tables, each with its DuckDB SQL where SQL can say it.

``documents`` play the archive's files (see cairnworks.sources.warehouse), ``embeddings`` its
image signatures, ``pages`` its titles, and ``events`` its decision log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnworks.functions import bits, names, text
from cairnworks.functions.simhash import simhash_arrow, simhash_md5
from cairnworks.operators import archives, clusters, diagnostics, ingest, moves, near, replay, review, stats, topics
from cairnworks.operators.components import connected_components, grow_components
from cairnworks.scratch import materialize, scratch_path
from cairnworks.sources.snapshots import Snapshots
from cairnworks.sources.warehouse import archive, table
from cairnworks.streaming.ingest import windowed_activity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The archive's tables in SQL.
_MODEL = """
WITH RECURSIVE docs AS (SELECT doc_id, lang, source, text, sha256(text) AS hash, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL),
files AS (SELECT hash, max(size) AS size, 'text/plain' AS mime, min(doc_id) AS first_seen_at FROM docs GROUP BY hash),
paths AS (SELECT doc_id AS id, hash, source AS drive_id,
  source || '/' || lang || '/note_' || (doc_id % 97) || '_v' || doc_id || '.txt' AS path,
  1600000000 + doc_id * 60 AS mtime, 1700000000 + doc_id AS observed_at,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'purgatory' ELSE 'active' END AS status FROM docs),
drives AS (SELECT DISTINCT source AS id, 'drive ' || source AS label, '/mnt/' || source AS root_path, CASE WHEN source = 'src0' THEN 'managed' ELSE 'scanned' END AS kind FROM docs),
ckeys AS (SELECT hash FROM paths GROUP BY hash HAVING count(*) > 1),
clusters AS (SELECT substr(sha256('exact|' || hash), 1, 16) AS id, 'exact' AS kind, CAST(NULL AS VARCHAR) AS label,
  CASE WHEN substr(hash, 1, 1) < '4' THEN hash END AS canonical_hash, CASE WHEN substr(hash, 1, 1) < '4' THEN 'resolved' ELSE 'open' END AS status, hash FROM ckeys JOIN files USING (hash) WHERE size >= 1),
members AS (SELECT id AS cluster_id, hash FROM clusters),
summary AS (SELECT c.id, c.kind, c.label, c.status, count(CASE WHEN p.status = 'active' THEN 1 END) AS n_active, count(p.id) AS n_total, count(DISTINCT m.hash) AS n_members,
  CAST(coalesce(sum(CASE WHEN p.status = 'active' THEN f.size END), 0) AS BIGINT) AS active_bytes, coalesce(max(CASE WHEN p.status = 'active' THEN f.size END), 0) AS max_active
  FROM clusters c JOIN members m ON m.cluster_id = c.id JOIN files f ON f.hash = m.hash LEFT JOIN paths p ON p.hash = m.hash GROUP BY c.id, c.kind, c.label, c.status)
"""


def query(name: str, sql: str | None = None, model: bool = True) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` follows the model's tables unless told otherwise."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (_MODEL if model else "") + sql
        return f

    return put


@query("a1_exact_groups", """SELECT f.hash, f.size, count(*) AS n_paths, f.size * (count(*) - 1) AS reclaimable, string_agg(p.path, '|' ORDER BY p.path) AS paths
FROM files f JOIN paths p USING (hash) WHERE p.status = 'active' AND f.size >= 1 GROUP BY f.hash, f.size HAVING count(*) > 1""")
def a1_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    found = clusters.exact_groups(a.files, a.paths)
    return found.select("hash", "size", "n_paths", "reclaimable", F.array_join(F.col("paths.path"), "|").alias("paths"))


@query("o1_top_groups", """SELECT f.hash, f.size * (count(*) - 1) AS reclaimable FROM files f JOIN paths p USING (hash) WHERE p.status = 'active' GROUP BY f.hash, f.size HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def o1_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    counts = a.paths.where("status = 'active'").groupBy("hash").agg(F.count("id").alias("n")).where("n > 1")
    rows = counts.join(a.files.select("hash", "size"), "hash").select("hash", (F.col("size") * (F.col("n") - 1)).alias("reclaimable"))
    return rows.orderBy(F.desc("reclaimable"), "hash").limit(20)


@query("a2_new_exact_clusters", """SELECT substr(sha256('exact|' || hash), 1, 16) AS cluster_id, hash FROM (SELECT hash FROM paths WHERE status = 'active' GROUP BY hash HAVING count(*) > 1)
WHERE hash NOT IN (SELECT hash FROM members WHERE hash < '8')""")
def a2_new_exact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return clusters.new_exact_clusters(a.files, a.paths, a.members.where("hash < '8'"))


@query("a3_storage_stats", """, live AS (SELECT DISTINCT hash FROM paths WHERE status = 'active'),
t AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total FROM paths JOIN files USING (hash) WHERE status = 'active'),
u AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS uniq FROM files JOIN live USING (hash)),
r AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS recl FROM paths JOIN files USING (hash) WHERE status = 'purgatory')
SELECT (SELECT count(*) FROM files) AS files_unique, (SELECT count(*) FROM paths) AS paths, (SELECT count(*) FROM paths WHERE status = 'active') AS paths_active,
 (SELECT count(*) FROM paths WHERE status <> 'active') AS paths_purgatory, (SELECT count(*) FROM drives) AS drives, uniq AS bytes_unique, total AS bytes_total, recl AS bytes_reclaimed,
 total - uniq AS bytes_saveable, 100.0::DOUBLE * (total - uniq) / greatest(total, 1) AS savings_pct FROM t, u, r""")
def a3_storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return stats.storage(a.files, a.paths, a.drives)


@query("a7_overview", """SELECT count(*) AS clusters_total, count(*) FILTER (WHERE status = 'open') AS clusters_unresolved, count(*) FILTER (WHERE status <> 'open') AS clusters_resolved,
 count(*) FILTER (WHERE status = 'open' AND kind IN ('exact', 'doc_version', 'near_image')) AS clusters_dedup_open, count(*) FILTER (WHERE kind = 'topic') AS topic_clusters,
 (SELECT count(*) FROM summary WHERE kind = 'exact' AND status = 'open' AND n_active > 0 AND active_bytes - max_active < 1048576) AS exact_hidden FROM clusters""")
def a7_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return stats.overview(a.clusters, clusters.summaries(a.clusters, a.members, a.files, a.paths))


@query("a7_open_by_kind", "SELECT kind, count(*) AS n FROM clusters WHERE status = 'open' GROUP BY kind")
def a7_open_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.open_by_kind(archive(spark, sf_dir).clusters)


_QUEUE = """SELECT id, kind, label, n_active, n_total, n_members, status <> 'open' AS resolved, active_bytes - max_active AS reclaimable FROM summary
WHERE n_active > 0 {} ORDER BY active_bytes - max_active DESC, active_bytes DESC, id LIMIT 500"""


@query("a9_review_queue", _QUEUE.format("AND status = 'open'"))
def a9_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return clusters.review_queue(clusters.summaries(a.clusters, a.members, a.files, a.paths))


@query("p10_queue_above_floor", _QUEUE.format("AND kind IN ('exact', 'topic') AND (kind <> 'exact' OR active_bytes - max_active >= 2000)"))
def p10_queue_above_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return clusters.review_queue(clusters.summaries(a.clusters, a.members, a.files, a.paths), True, ("exact", "topic"), min_reclaimable=2000)


@query("a10_cluster_details", """SELECT m.cluster_id, m.hash, f.size, f.mime, count(p.id) AS n_paths, string_agg(p.status || ':' || p.path, '|' ORDER BY p.status, p.path) AS paths
FROM members m JOIN files f USING (hash) LEFT JOIN paths p USING (hash) GROUP BY m.cluster_id, m.hash, f.size, f.mime""")
def a10_cluster_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    rows = clusters.details(a.members, a.files, a.paths)
    listed = F.array_join(F.transform("paths", lambda p: F.concat(p["status"], F.lit(":"), p["path"])), "|")
    return rows.select("cluster_id", "hash", "size", "mime", F.size("paths").cast("long").alias("n_paths"), listed.alias("paths"))


@query("a11_rationales", """SELECT m.cluster_id, count(*) AS n_copies, count(DISTINCT regexp_extract(p.path, '([^/]*)$', 1)) > 1 AS names_differ,
 'identical content — sha256 ' || substr(m.hash, 1, 12) || '…, ' || format('{:,}', f.size) || ' bytes, ' || count(*) || ' copies; ' ||
 CASE WHEN count(DISTINCT regexp_extract(p.path, '([^/]*)$', 1)) > 1 THEN 'filenames differ — matched by content' ELSE 'same filename in multiple locations' END AS rationale
FROM members m JOIN files f USING (hash) JOIN paths p USING (hash) WHERE p.status = 'active' GROUP BY m.cluster_id, m.hash, f.size""")
def a11_rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return clusters.exact_rationales(a.members, a.files, a.paths)


@query("a13_purgatory_summary", "SELECT count(*) AS count, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM paths JOIN files USING (hash) WHERE status = 'purgatory'")
def a13_purgatory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return stats.purgatory(a.files, a.paths)


@query("o3_purgatory_list", "SELECT id, drive_id, path, hash, size, mime FROM paths JOIN files USING (hash) WHERE status = 'purgatory' ORDER BY size DESC, path, id LIMIT 1000")
def o3_purgatory_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return stats.purgatory_list(a.files, a.paths)


@query("a14_orphans", "SELECT count(*) AS n FROM files f WHERE NOT EXISTS (SELECT 1 FROM paths p WHERE p.hash = f.hash AND p.status = 'active')")
def a14_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return stats.orphans(a.files, a.paths).agg(F.count(F.lit(1)).alias("n"))


@query("p9_search", "SELECT id, drive_id, path, status, hash, size, mime FROM paths JOIN files USING (hash) WHERE status = 'active' AND path ILIKE '%NOTE_1%' ORDER BY size DESC, path, id LIMIT 200")
def p9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return stats.search(a.files, a.paths, "NOTE_1")


@query("j2_one_location", """, f1 AS (SELECT hash, min(struct_pack(d := drive_id, p := path)) AS x FROM paths WHERE status = 'active' GROUP BY hash)
SELECT files.hash, mime, size, root_path || '/' || x.p AS abspath, x.p AS rel FROM files JOIN f1 USING (hash) JOIN drives ON drives.id = x.d""")
def j2_one_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return stats.one_location(a.files, a.paths, a.drives)


@query("j5_clustered_hashes", "SELECT DISTINCT hash FROM members JOIN clusters ON clusters.id = cluster_id WHERE kind = 'exact'".replace("SELECT DISTINCT hash", "SELECT DISTINCT members.hash"))
def j5_clustered_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return a.members.join(a.clusters.where("kind = 'exact'").select(F.col("id").alias("cluster_id")), "cluster_id").select("hash").distinct()


@query("p7_stale_paths", "SELECT id, drive_id, path, hash, size FROM paths JOIN files USING (hash) WHERE status = 'active' AND observed_at < 1700000300 AND id % 10 <> 3")
def p7_stale_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that failed in the run (here: id ending in 3) are no deletions."""
    a = archive(spark, sf_dir)
    return stats.stale(a.files, a.paths, 1_700_000_300, a.paths.where("id % 10 = 3"))


@query("p16_highlighted", "SELECT id, path, contains(lower(path), '/en/') OR contains(lower(path), 'note_5_') AS highlighted FROM paths")
def p16_highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.highlighted(archive(spark, sf_dir).paths, ["/EN/", "note_5_"])


@query("p1_to_hash", """, l AS (SELECT drive_id, path, size + (id % 5 = 0)::INT AS size, mtime + (id % 7 = 0)::INT AS mtime, hash, id FROM paths JOIN files USING (hash) WHERE id % 11 <> 0)
SELECT drive_id, path, size, mtime, CASE WHEN id % 5 <> 0 AND id % 7 <> 0 THEN hash END AS known_hash FROM l""")
def p1_to_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new listing in which some files changed size or time."""
    a = archive(spark, sf_dir)
    listing = a.paths.join(a.files.select("hash", "size"), "hash").where("id % 11 <> 0")
    listing = listing.select("drive_id", "path", (F.col("size") + (F.col("id") % 5 == 0).cast("int")).alias("size"), (F.col("mtime") + (F.col("id") % 7 == 0).cast("int")).alias("mtime"))
    return ingest.to_hash(listing, a.paths, a.files)


@query("j12_reconcile", """, gone AS (SELECT p.drive_id, count(*) AS missing, CAST(sum(size) AS BIGINT) AS bytes_missing FROM paths p JOIN files USING (hash) WHERE p.status = 'active' AND p.id % 6 = 0 AND p.drive_id NOT IN ('src0', 'src1') GROUP BY p.drive_id),
chk AS (SELECT drive_id, count(*) AS checked FROM paths WHERE status = 'active' GROUP BY drive_id)
SELECT d.id AS drive_id, d.label, d.kind = 'managed' AS skipped_managed, d.id = 'src1' AS root_unreachable, CASE WHEN d.kind = 'managed' THEN 0 ELSE coalesce(checked, 0) END AS checked,
 coalesce(missing, 0) AS missing, coalesce(bytes_missing, 0) AS bytes_missing FROM drives d LEFT JOIN chk ON chk.drive_id = d.id LEFT JOIN gone ON gone.drive_id = d.id""")
def j12_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing without every sixth path; src1 is unreachable, src0 managed."""
    a = archive(spark, sf_dir)
    up = a.drives.where("id not in ('src1', 'src0')").select(F.col("id").alias("drive_id"))
    lost = ingest.missing_paths(a.paths, a.files, a.drives, a.paths.where("id % 6 <> 0"), up)
    return ingest.reconcile_report(a.paths, a.drives, lost, up).drop("sample")


# --- text functions and signatures


@query("n1_tokens", "SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents)", False)
def n1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("n2_shingles", """SELECT doc_id, CAST(CASE WHEN len(t) >= 4 THEN len(t) - 3 WHEN len(t) > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_shingles,
 CASE WHEN len(t) > 0 THEN array_to_string(t[1:4], ' ') END AS first_shingle FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents)""", False)
def n2_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t")).select("doc_id", text.shingles(F.col("t"), 4).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_shingles"), F.get("s", F.lit(0)).alias("first_shingle"))


_SIMHASH = """t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(t) >= 4 THEN list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS s FROM t),
h AS (SELECT doc_id, CAST(('0x' || substr(md5(s), 1, 16)) AS UBIGINT) AS h FROM s),
b AS (SELECT doc_id, count(*) AS n, """ + ", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in range(64)) + """ FROM h GROUP BY doc_id),
sig AS (SELECT d.doc_id, coalesce(""" + " + ".join(f"(CASE WHEN 2 * b{b} > n THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END)" for b in range(64)) + """, 0::UBIGINT) AS sig FROM documents d LEFT JOIN b USING (doc_id))"""


@query("n3_simhash", "WITH " + _SIMHASH + " SELECT doc_id, printf('%016x', sig) AS sig FROM sig", False)
def n3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_md5(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", bits.to_hex(F.col("sig")).alias("sig"))


@query("n3_simhash_blake2")
def n3_simhash_blake2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_arrow(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", bits.to_hex(F.col("sig")).alias("sig"))


@query("n11_stems", """SELECT id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '(\\.[^./]+)$', 1) AS suffix,
 regexp_extract(regexp_replace(lower(path), '_v\\d+', '', 'g'), '([^/]*)\\.[^.]+$', 1) AS stem FROM paths""")
def n11_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return archive(spark, sf_dir).paths.select("id", names.parent_dir(p).alias("parent"), names.suffix(p).alias("suffix"), names.normal_stem(p).alias("stem"))


_TITLES = "t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"
_SLUG = "coalesce(nullif(substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), ''), 'untitled')"


@query("n13_slugs", f"WITH {_TITLES} SELECT page_id, title, {_SLUG} AS slug FROM t", False)
def n13_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), text.slug(title).alias("slug"))


@query("n15_model_answers", """WITH j AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Sure: ' ELSE '' END || '{"topic": "' || CASE WHEN event_id % 9 = 0 THEN ' ' ELSE event_type END || '", "kind": "' || CASE event_id % 3 WHEN 0 THEN 'note' ELSE 'memo' END || '", "confidence": ' || CASE WHEN event_id % 5 = 0 THEN '"high"' ELSE '0.75' END || '}' AS answer FROM events),
k AS (SELECT event_id, regexp_extract(answer, '\\{.*\\}', 0) AS b FROM j)
SELECT event_id, trim(json_extract_string(b, '$.topic')) AS topic, regexp_replace(lower(trim(json_extract_string(b, '$.topic'))), '[^a-z0-9]+', '-', 'g') AS slug,
 CASE WHEN event_id % 3 = 0 THEN 'note' ELSE 'other' END AS kind, CASE WHEN event_id % 5 = 0 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM k WHERE trim(json_extract_string(b, '$.topic')) <> ''""", False)
def n15_model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers with prose around some, unknown kinds, and words for numbers."""
    e = F.col("event_id")
    answer = F.concat(
        F.when(e % 4 == 0, "Sure: ").otherwise(""), F.lit('{"topic": "'), F.when(e % 9 == 0, " ").otherwise(F.col("event_type")), F.lit('", "kind": "'),
        F.when(e % 3 == 0, "note").otherwise("memo"), F.lit('", "confidence": '), F.when(e % 5 == 0, '"high"').otherwise("0.75"), F.lit("}"),
    )
    return table(spark, sf_dir, "events").select("event_id", text.model_answer(answer).alias("r")).where("r is not null").select("event_id", "r.*")


# --- graph and near duplicates

_IMAGES = """img AS (SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS hash, 'shape' || label AS aspect, """ + " + ".join(
    f"(CASE WHEN embedding[{i + 1}] > embedding[{(i + 1) % 64 + 1}] THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END)" for i in range(64)
) + """ AS sig FROM embeddings),
good AS (SELECT * FROM img WHERE bit_count(sig) BETWEEN 8 AND 56),
imgpairs AS (SELECT a.hash AS a, b.hash AS b, CAST(bit_count(xor(a.sig, b.sig)) AS INTEGER) AS distance FROM good a JOIN good b ON a.aspect = b.aspect AND a.hash < b.hash
 WHERE bit_count(xor(a.sig, b.sig)) <= {radius})"""


def _image_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("hash"), F.concat(F.lit("shape"), "label").alias("aspect"), bits.sign_hash(F.col("embedding")).alias("sig"))


@query("n6_sign_hashes", "WITH " + _IMAGES.replace("{radius}", "6") + " SELECT hash, printf('%016x', sig) AS sig, CAST(bit_count(sig) AS INTEGER) AS n_bits, CAST((sig >> 56) & 255 AS BIGINT) AS last_band FROM img", False)
def n6_sign_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sig")
    return _image_signatures(spark, sf_dir).select("hash", bits.to_hex(s).alias("sig"), F.bit_count(s).alias("n_bits"), bits.band(s, F.lit(7)).cast("long").alias("last_band"))


@query("n8_aspects", """SELECT o_orderkey, CASE WHEN w = 0 OR h = 0 THEN 'unknown' WHEN w / h >= 2.2 THEN 'pano_wide' WHEN w / h >= 1.45 THEN 'wide' WHEN w / h >= 1.15 THEN 'landscape' WHEN w / h >= 0.87 THEN 'square'
 WHEN w / h >= 0.69 THEN 'portrait' WHEN w / h >= 0.45 THEN 'tall' ELSE 'pano_tall' END AS aspect FROM (SELECT o_orderkey, CAST(o_custkey % 300 AS DOUBLE) AS w, CAST(o_orderkey % 200 AS DOUBLE) AS h FROM orders)""", False)
def n8_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 300).cast("double").alias("w"), (F.col("o_orderkey") % 200).cast("double").alias("h"))
    return rows.select("o_orderkey", bits.aspect_bucket(F.col("w"), F.col("h")).alias("aspect"))


@query("a18_popcounts", "WITH " + _IMAGES.replace("{radius}", "6") + " SELECT CAST(bit_count(sig) AS INTEGER) AS n_bits, count(*) AS n, count(DISTINCT sig) AS n_distinct FROM img GROUP BY 1", False)
def a18_popcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _image_signatures(spark, sf_dir).groupBy(F.bit_count("sig").alias("n_bits")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sig").alias("n_distinct"))


@query("a18_common_signatures", "WITH " + _IMAGES.replace("{radius}", "6") + """, coarse AS (SELECT sig & 15::UBIGINT AS sig FROM img)
SELECT CAST(sig AS BIGINT) AS sig, count(*) AS n, CAST(bit_count(sig) AS INTEGER) AS n_bits FROM coarse GROUP BY sig ORDER BY n DESC, sig LIMIT 6""", False)
def a18_common_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six commonest values, of the signatures' last four bits so that values repeat."""
    return diagnostics.common_signatures(_image_signatures(spark, sf_dir).select(F.col("sig").bitwiseAND(F.lit(15)).alias("sig")))


@query("a18_cluster_sizes", "SELECT c.id AS cluster_id, count(m.hash) AS n_members FROM clusters c JOIN members m ON m.cluster_id = c.id WHERE c.kind = 'exact' GROUP BY c.id")
def a18_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return diagnostics.cluster_sizes(a.clusters, a.members, "exact")


@query("p15_missing_dimensions", "SELECT DISTINCT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS hash FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0", False)
def p15_missing_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths are unknown for every seventh signature, heights for every eleventh."""
    v = F.col("vec_id")
    known = lambda n: F.when(v % n != 0, F.lit(640))
    rows = table(spark, sf_dir, "embeddings").select(F.lpad(v.cast("string"), 8, "0").alias("hash"), F.lit("phash_image").alias("algo"), known(7).alias("w"), known(11).alias("h"))
    return diagnostics.without_dimensions(rows)


@query("p11_hash_prefix", "SELECT hash, size FROM files WHERE hash LIKE 'a%'")
def p11_hash_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.hash_prefix(archive(spark, sf_dir).files, "a").select("hash", "size")


@query("o10_drives_by_label", "SELECT id, label, root_path, kind FROM drives ORDER BY label, id")
def o10_drives_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.drives_by_label(archive(spark, sf_dir).drives).select("id", "label", "root_path", "kind")


@query("a19_exact_verdicts", """, disk AS (SELECT p.id, CASE WHEN p.id % 5 = 0 THEN NULL ELSE f.size + CASE WHEN p.id % 11 = 0 THEN 1 ELSE 0 END END AS disk_size,
 CASE WHEN p.id % 5 = 0 OR p.id % 3 = 0 THEN NULL WHEN p.id % 7 = 0 THEN 'other' ELSE p.hash END AS fresh_hash FROM paths p JOIN files f USING (hash)),
g AS (SELECT p.hash, count(*) AS n_paths, count(d.disk_size) AS n_found, count(CASE WHEN d.disk_size IS NOT NULL AND d.fresh_hash IS NULL THEN 1 END) AS n_unread,
 count(DISTINCT d.disk_size) AS n_sizes, count(DISTINCT d.fresh_hash) AS n_hashes, min(d.fresh_hash) AS fresh FROM paths p LEFT JOIN disk d ON d.id = p.id WHERE p.status = 'active' GROUP BY p.hash)
SELECT hash, size, n_paths, n_found, n_sizes, n_hashes, CASE WHEN n_found = 0 THEN 'missing' WHEN n_sizes > 1 THEN 'sizes differ' WHEN n_hashes > 1 THEN 'hashes differ'
 WHEN n_hashes = 1 AND fresh <> hash THEN 'changed' WHEN n_unread > 0 THEN 'not hashed' ELSE 'identical' END AS verdict FROM g JOIN files USING (hash)""")
def a19_exact_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disk where some files are gone, some have grown, some weren't read and some have other contents."""
    a = archive(spark, sf_dir)
    i = F.col("id")
    disk = a.paths.join(a.files.select("hash", "size"), "hash").select(
        "id",
        F.when(i % 5 != 0, F.col("size") + F.when(i % 11 == 0, 1).otherwise(0)).alias("disk_size"),
        F.when((i % 5 != 0) & (i % 3 != 0), F.when(i % 7 == 0, "other").otherwise(F.col("hash"))).alias("fresh_hash"),
    )
    return diagnostics.exact_verdicts(a.files, a.paths, disk)


@query("j10_band_pairs", "WITH " + _IMAGES.replace("{radius}", "6") + " SELECT * FROM imgpairs", False)
def j10_band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight bands find every pair within six bits."""
    return near.band_pairs(_image_signatures(spark, sf_dir))


_NEAR = """, """ + _SIMHASH + """,
sigs AS (SELECT DISTINCT p.hash, s.sig FROM paths p JOIN sig s ON s.doc_id = p.id WHERE p.status = 'active'),
keyed AS (SELECT DISTINCT hash, 'd:' || regexp_extract(path, '^(.*)/[^/]*$', 1) AS block FROM paths WHERE status = 'active'
  UNION SELECT DISTINCT hash, 's:' || regexp_extract(regexp_replace(lower(path), '_v\\d+', '', 'g'), '([^/]*)\\.[^.]+$', 1) FROM paths WHERE status = 'active'),
dp AS (SELECT DISTINCT x.hash AS a, y.hash AS b, CAST(bit_count(xor(sx.sig, sy.sig)) AS INTEGER) AS distance FROM keyed x JOIN keyed y ON x.block = y.block AND x.hash < y.hash
  JOIN sigs sx ON sx.hash = x.hash JOIN sigs sy ON sy.hash = y.hash WHERE bit_count(xor(sx.sig, sy.sig)) <= 16)
"""


def _document_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is signed where it is read; of copies the signatures are shuffled, never the texts."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("hash"), "text")
    return materialize(simhash_md5(docs, "hash", "text").groupBy("hash").agg(F.min("sig").alias("sig")), "signatures")


@query("j9_document_pairs", _NEAR + "SELECT * FROM dp")
def j9_document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.document_pairs(archive(spark, sf_dir).paths, _document_signatures(spark, sf_dir))


_REACH = """, e AS (SELECT a, b FROM dp UNION SELECT b, a FROM dp), reach(n, m) AS (SELECT a, a FROM e UNION SELECT r.n, e.b FROM reach r JOIN e ON e.a = r.m), comp AS (SELECT n AS hash, min(m) AS component FROM reach GROUP BY n)
"""


@query("g1_components", _NEAR + _REACH + "SELECT hash, component FROM comp")
def g1_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    signatures = _document_signatures(spark, sf_dir)
    return near.named_components(near.document_links(archive(spark, sf_dir).paths, signatures), signatures.select("hash"))


@query("g3_document_clusters", _NEAR + _REACH + """, bad AS (SELECT DISTINCT component FROM comp WHERE hash < '1')
SELECT substr(sha256('doc_version|' || component), 1, 16) AS cluster_id, 'doc_version' AS kind, 'document versions' AS label, hash FROM comp WHERE component NOT IN (SELECT component FROM bad)""")
def g3_document_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that touch hashes clustered before (here: those below '1') are left alone."""
    a = archive(spark, sf_dir)
    return near.document_clusters(a.paths, _document_signatures(spark, sf_dir), a.files.where("hash < '1'").select("hash"))


@query("g4_image_clusters", "WITH RECURSIVE " + _IMAGES.replace("{radius}", "18").replace("imgpairs", "dp") + _REACH + """, n AS (SELECT component, count(*) AS n FROM comp GROUP BY component HAVING count(*) <= 200)
SELECT substr(sha256('near_image|' || component), 1, 16) AS cluster_id, 'near_image' AS kind, 'similar images' AS label, hash FROM comp JOIN n USING (component)""", False)
def g4_image_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a radius wide enough to find links among the embeddings, blocked by shape alone."""
    signatures = _image_signatures(spark, sf_dir).where(bits.informative(F.col("sig")))
    links = near.block_links(signatures.select(F.col("aspect").alias("block"), near.node_of(F.col("hash")).alias("node"), "sig"), 18)
    return clusters.as_clusters(near.named_components(links, signatures.select("hash")), "near_image", "similar images", near.MAX_IMAGE_CLUSTER)


def _least_labels(rounds: int = 24) -> str:
    """Components of all orders' links by labels that spread a step a round; the links are dense, a few steps reach all."""
    parts = ["""WITH e AS (SELECT DISTINCT o_custkey AS a, -o_orderkey % 977 - 1 AS b FROM orders), s AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), l0 AS (SELECT DISTINCT a AS node, a AS component FROM s)"""]
    parts += [f"l{r + 1} AS MATERIALIZED (SELECT s.a AS node, least(min(x.component), min(y.component)) AS component FROM s JOIN l{r} x ON x.node = s.a JOIN l{r} y ON y.node = s.b GROUP BY s.a)" for r in range(rounds)]
    return ", ".join(parts) + f" SELECT node, component FROM l{rounds}"


def _order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and groups of orders that all orders link."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (-F.col("o_orderkey") % 977 - 1).alias("dst"))


@query("g1_integer_components", _least_labels(), False)
def g1_integer_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_order_links(spark, sf_dir))


@query("g1_order_components", _least_labels(), False)
def g1_order_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_order_links(spark, sf_dir))


@query("g7_grown_components", _least_labels(), False)
def g7_grown_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders' links in four parts, each added to the components of those before."""
    links = _order_links(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("src", "dst"), F.lit(4)))
    known = spark.createDataFrame([], links.select(F.col("src").alias("node"), F.col("dst").alias("component")).schema)
    for part in range(4):
        changed, _ = grow_components(known, links.where(F.col("part") == part))
        changed = materialize(changed, "changed")
        known = materialize(known.join(changed, "node", "left_anti").union(changed), "components")
    return known


@query("g7_grown_versions", _NEAR + _REACH + "SELECT hash, component FROM comp")
def g7_grown_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document versions when half of the documents came later: only tiles with later ones are compared."""
    paths, signatures = archive(spark, sf_dir).paths, _document_signatures(spark, sf_dir)
    later = F.substring("hash", 1, 1).isin(*"89abcdef")
    known = materialize(connected_components(near.document_links(paths, signatures.where(~later)), "a", "b"), "components")
    changed, _ = near.grown_documents(paths, signatures.withColumn("fresh", later), known)
    changed = materialize(changed, "changed")
    return near.named(known.join(changed, "node", "left_anti").union(changed), signatures.select("hash"))


_BANDED = "WITH RECURSIVE " + _IMAGES.replace("{radius}", "22") + """, dp AS (SELECT p.* FROM imgpairs p JOIN good x ON x.hash = p.a JOIN good y ON y.hash = p.b
 WHERE len(list_filter(range(8), lambda i: ((x.sig >> (8 * i)::UBIGINT) & 255) = ((y.sig >> (8 * i)::UBIGINT) & 255))) > 0)"""


@query("j10_band_pairs_wide", _BANDED + " SELECT * FROM dp", False)
def j10_band_pairs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within a radius at which the embeddings have links, and with a band in common."""
    return near.band_pairs(_image_signatures(spark, sf_dir), 22)


@query("g4_banded_clusters", _BANDED + _REACH + """, old AS (SELECT DISTINCT component FROM comp WHERE hash < '00000030'), n AS (SELECT component FROM comp GROUP BY component HAVING count(*) <= 200)
SELECT substr(sha256('near_image|' || component), 1, 16) AS cluster_id, 'near_image' AS kind, 'similar images' AS label, hash FROM comp JOIN n USING (component) WHERE component NOT IN (SELECT component FROM old)""", False)
def g4_banded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near images as the index clusters them, at that radius; components with an image below '00000030' are left alone."""
    signatures = _image_signatures(spark, sf_dir)
    return near.image_clusters(signatures, signatures.where("hash < '00000030'").select("hash"), 22)


# --- topics


def _topic_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as text files with a Markdown title; every ninth title is no heading."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    rows = table(spark, sf_dir, "pages").select(F.lpad(F.col("page_id").cast("string"), 8, "0").alias("hash"), "page_id", F.concat(F.when(F.col("page_id") % 9 == 0, "").otherwise("\n# "), title, F.lit(" #\nbody")).alias("text"))
    paths = rows.select("hash", F.when(F.col("page_id") % 10 == 7, "purgatory").otherwise("active").alias("status"))
    return rows, paths


#: A heading has 60 characters after the mark and the space; the closing marks go after that cut.
_TOPICS = """WITH p AS (SELECT page_id, lpad(CAST(page_id AS VARCHAR), 8, '0') AS hash, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, page_id % 10 <> 7 AS live FROM pages),
t0 AS (SELECT hash, trim(rtrim(trim(substr(trim(title || ' #'), 1, 60)), '#')) AS topic, live FROM p WHERE page_id % 9 <> 0),
t AS (SELECT hash, topic, live, coalesce(nullif(substr(trim(regexp_replace(lower(topic), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), ''), 'untitled') AS slug FROM t0 WHERE length(topic) > 0)
"""


@query("t1_headings", _TOPICS + "SELECT hash, topic, slug, 'document' AS kind, 0.9::DOUBLE AS confidence FROM t", False)
def t1_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topics.infer_by_heading(_topic_rows(spark, sf_dir)[0], "hash", "text")
    return found.withColumn("confidence", F.col("confidence").cast("double"))


@query("t5_tags", _TOPICS + """SELECT hash, 'topic' AS key, topic AS value, 'rule' AS source, 0.9::DOUBLE AS confidence FROM t UNION ALL SELECT hash, 'topic_slug', slug, 'rule', 0.9 FROM t UNION ALL SELECT hash, 'topic_file_kind', 'document', 'rule', 0.9 FROM t""", False)
def t5_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.as_tags(topics.infer_by_heading(_topic_rows(spark, sf_dir)[0], "hash", "text"), "rule")


@query("a12_topic_groups", _TOPICS + "SELECT slug, min(topic) AS label, count(*) AS n_hashes FROM t WHERE live GROUP BY slug HAVING count(*) >= 2", False)
def a12_topic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, paths = _topic_rows(spark, sf_dir)
    tags = topics.as_tags(topics.infer_by_heading(rows, "hash", "text"), "rule")
    return topics.topic_groups(tags, paths).select("slug", "label", "n_hashes").distinct()


@query("t6_topic_clusters", _TOPICS + """, g AS (SELECT slug, min(topic) AS label, min(hash) AS first FROM t WHERE live GROUP BY slug HAVING count(*) >= 2), bad AS (SELECT DISTINCT slug FROM t WHERE live AND hash < '00000020')
SELECT substr(sha256('topic|' || first), 1, 16) AS cluster_id, 'topic' AS kind, label, hash FROM g JOIN t USING (slug) WHERE live AND slug NOT IN (SELECT slug FROM bad)""", False)
def t6_topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, paths = _topic_rows(spark, sf_dir)
    tags = topics.as_tags(topics.infer_by_heading(rows, "hash", "text"), "rule")
    return topics.topic_clusters(tags, paths, rows.where("page_id < 20").select("hash"))


@query("t1_whole_headings", _TOPICS + "SELECT hash, topic, slug, 'document' AS kind, 0.9::DOUBLE AS confidence FROM t", False)
def t1_whole_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topics.infer_by_heading(_topic_rows(spark, sf_dir)[0], "hash", "text")
    return found.withColumn("confidence", F.col("confidence").cast("double"))


@query("t6_whole_topic_clusters", _TOPICS + """, g AS (SELECT slug, min(topic) AS label, min(hash) AS first FROM t WHERE live GROUP BY slug HAVING count(*) >= 2)
SELECT substr(sha256('topic|' || first), 1, 16) AS cluster_id, 'topic' AS kind, label, hash FROM g JOIN t USING (slug) WHERE live""", False)
def t6_whole_topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, paths = _topic_rows(spark, sf_dir)
    tags = topics.as_tags(topics.infer_by_heading(rows, "hash", "text"), "rule")
    return topics.topic_clusters(tags, paths, rows.limit(0).select("hash"))


# --- review and relocation

_KEEP = """, act AS (SELECT m.cluster_id, p.id AS path_id, m.hash FROM members m JOIN paths p USING (hash) WHERE p.status = 'active'),
req AS (SELECT id AS cluster_id, (SELECT min(path_id) FROM act WHERE act.cluster_id = clusters.id) AS keep FROM clusters WHERE status = 'open'),
gone AS (SELECT act.path_id FROM act JOIN req USING (cluster_id) WHERE keep IS NOT NULL AND path_id <> keep)
"""


def _keep_all(spark: SparkSession, sf_dir: str):
    a = archive(spark, sf_dir)
    actives = a.members.join(a.paths.where("status = 'active'").select("hash", F.col("id").alias("path_id")), "hash")
    requests = actives.groupBy("cluster_id").agg(F.min("path_id").alias("keep_path_id")).join(a.clusters.where("status = 'open'").select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    return a, review.resolve_keep(a.clusters, a.members, a.paths, requests)


@query("d2_keep_paths", _KEEP + "SELECT id, hash, path, CASE WHEN id IN (SELECT path_id FROM gone) THEN 'purgatory' ELSE status END AS status FROM paths")
def d2_keep_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, out = _keep_all(spark, sf_dir)
    return review.fold_paths(a.paths, out.path_changes).select("id", "hash", "path", "status")


@query("d2_keep_clusters", _KEEP + """SELECT c.id, CASE WHEN r.keep IS NOT NULL THEN c.hash ELSE c.canonical_hash END AS canonical_hash, CASE WHEN r.keep IS NOT NULL THEN 'resolved' ELSE c.status END AS status FROM clusters c LEFT JOIN req r ON r.cluster_id = c.id""")
def d2_keep_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, out = _keep_all(spark, sf_dir)
    return review.fold_clusters(a.clusters, out.cluster_changes).select("id", "canonical_hash", "status")


@query("d3_purge_paths", ", gone AS (SELECT p.id FROM paths p JOIN members m USING (hash) WHERE m.cluster_id < '8') SELECT id, CASE WHEN id IN (SELECT id FROM gone) THEN 'purgatory' ELSE status END AS status FROM paths")
def d3_purge_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    out = review.purge_all(a.clusters, a.members, a.paths, a.clusters.where("id < '8'").select(F.col("id").alias("cluster_id")))
    return review.fold_paths(a.paths, out.path_changes).select("id", "status")


@query("d5_undo_roundtrip", "SELECT id, status FROM paths")
def d5_undo_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keeping one path of every open cluster and undoing all of it leaves every status as it was."""
    a, out = _keep_all(spark, sf_dir)
    after = review.fold_paths(a.paths, out.path_changes)
    back, _, _ = review.undo(out.decisions.withColumn("id", F.lit(1)))
    return review.fold_paths(after, back).select("id", "status")


@query("d6_restore", ", back AS (SELECT p.id, p.hash FROM paths p JOIN drives d ON d.id = p.drive_id WHERE p.status = 'purgatory' AND d.kind <> 'managed') SELECT c.id, CASE WHEN c.hash IN (SELECT hash FROM back) THEN 'open' ELSE c.status END AS status FROM clusters c")
def d6_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restoring all that may be restored reopens the resolved clusters it belongs to."""
    a = archive(spark, sf_dir)
    out = review.restore(a.clusters, a.members, a.paths, a.drives, a.paths.where("status = 'purgatory'").select(F.col("id").alias("path_id")))
    return review.fold_clusters(a.clusters, out.cluster_changes).select("id", "status")


_LOG = """WITH log AS (SELECT event_id AS id, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'undo' WHEN event_id % 17 = 0 THEN 'apply_move' ELSE 'resolve_keep' END AS action, CAST(json_extract_string(props, '$.k') AS BIGINT) AS target FROM events),
live AS (SELECT * FROM log WHERE action <> 'undo' AND id NOT IN (SELECT target FROM log WHERE action = 'undo' AND target IS NOT NULL))
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("event_type").alias("undo_type"))
    action = F.when(F.col("event_type") == F.col("undo_type"), "undo").when(F.col("event_id") % 17 == 0, "apply_move").otherwise("resolve_keep")
    payload = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("target")))
    return events.join(F.broadcast(first)).select(F.col("event_id").alias("id"), action.alias("action"), payload.alias("payload"))  # one row joins all


@query("d5_not_undone", _LOG + "SELECT action, count(*) AS n, max(id) AS last FROM live GROUP BY action", False)
def d5_not_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.not_undone(_log(spark, sf_dir)).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


@query("d5_next_undo", _LOG + "SELECT id, action, action IN ('apply_move', 'apply_remove') AS needs_process_undo FROM live ORDER BY id DESC LIMIT 1", False)
def d5_next_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.next_undo(_log(spark, sf_dir)).select("id", "action", "needs_process_undo")


_AS_OF = """, e AS (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
l AS (SELECT id, k, CASE WHEN id % 3 = 0 THEN 'undo' WHEN id % 17 = 1 THEN 'restore' WHEN id % 19 = 1 THEN 'apply_move' ELSE 'resolve_keep' END AS action, id - 1 - k % 3 AS target, (id * 7 + k) % 700 AS pid FROM e),
u AS (SELECT min(id) AS id, target FROM l WHERE action = 'undo' AND id <= 6000 GROUP BY target),
w(root, top, n) AS (SELECT target, id, 1 FROM u UNION ALL SELECT root, u.id, n + 1 FROM w JOIN u ON u.target = w.top),
live AS (SELECT * FROM l WHERE id <= 6000 AND action <> 'undo' AND id NOT IN (SELECT root FROM w GROUP BY root HAVING max(n) % 2 = 1))"""


def _decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log in which every third is an undo, of decisions and of undos alike."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    pid = (e * 7 + k) % 700
    action = F.when(e % 3 == 0, "undo").when(e % 17 == 1, "restore").when(e % 19 == 1, "apply_move").otherwise("resolve_keep")
    cluster = F.concat(F.lit("c"), k)
    payload = (
        F.when(action == "undo", F.to_json(F.struct((e - 1 - k % 3).alias("target"))))
        .when(action == "restore", F.to_json(F.struct(pid.alias("path_id"), F.array(F.struct(cluster.alias("cluster_id"), F.lit("resolved").alias("prev_status"), F.concat(F.lit("x"), e).alias("prev_canonical"))).alias("reopened"))))
        .when(action == "apply_move", F.to_json(F.struct(pid.alias("path_id"), F.struct(F.lit("old").alias("drive_id"), F.concat(F.lit("old/"), pid).alias("path")).alias("src"), F.struct(F.lit("new").alias("drive_id"), F.concat(F.lit("new/"), e).alias("path")).alias("dest"))))
        .otherwise(F.to_json(F.struct(cluster.alias("cluster_id"), (e * 3 % 500).alias("kept_path_id"), F.array(F.struct(pid.alias("id"), F.lit("active").alias("prev_status"))).alias("purged"), F.concat(F.lit("x"), e).alias("prev_canonical"), F.lit("open").alias("prev_status"))))
    )
    return table(spark, sf_dir, "events").select(e.alias("id"), action.alias("action"), payload.alias("payload"))


@query("d5_paths_as_of", _AS_OF + """,
f AS (SELECT pid, arg_min(CASE action WHEN 'restore' THEN 'purgatory' ELSE 'active' END, id) FILTER (WHERE action <> 'apply_move') AS was, count(*) FILTER (WHERE action = 'apply_move') AS moved FROM l WHERE action <> 'undo' GROUP BY pid),
n AS (SELECT pid, arg_max(CASE action WHEN 'restore' THEN 'active' ELSE 'purgatory' END, id) FILTER (WHERE action <> 'apply_move') AS status, max(id) FILTER (WHERE action = 'apply_move') AS place FROM live GROUP BY pid)
SELECT p.id, p.hash, CASE WHEN place IS NOT NULL THEN 'new' WHEN moved > 0 THEN 'old' ELSE drive_id END AS drive_id, CASE WHEN place IS NOT NULL THEN 'new/' || place WHEN moved > 0 THEN 'old/' || p.id ELSE path END AS path,
 coalesce(n.status, f.was, p.status) AS status FROM paths p LEFT JOIN f ON f.pid = p.id LEFT JOIN n ON n.pid = p.id""")
def d5_paths_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths once decision 6000 was made, whatever was decided and undone before and after."""
    return replay.paths_as_of(archive(spark, sf_dir).paths, _decision_log(spark, sf_dir), 6000)


@query("d5_clusters_as_of", _AS_OF + """,
n AS (SELECT 'c' || k AS id, arg_max(struct_pack(action := action, pid := id * 3 % 500), id) AS x FROM live WHERE action <> 'apply_move' GROUP BY k),
f AS (SELECT 'c' || k AS id, arg_min(struct_pack(canonical := 'x' || id, status := CASE action WHEN 'restore' THEN 'resolved' ELSE 'open' END), id) AS was FROM l WHERE action NOT IN ('undo', 'apply_move') GROUP BY k)
SELECT c.id, CASE WHEN x IS NULL THEN was.canonical WHEN x.action = 'resolve_keep' THEN p.hash END AS canonical_hash, CASE WHEN x IS NULL THEN coalesce(was.status, 'now') WHEN x.action = 'restore' THEN 'open' ELSE 'resolved' END AS status
FROM (SELECT DISTINCT 'c' || k AS id FROM e) c LEFT JOIN n USING (id) LEFT JOIN f USING (id) LEFT JOIN paths p ON p.id = x.pid AND x.action = 'resolve_keep'""")
def d5_clusters_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat(F.lit("c"), F.get_json_object("props", "$.k"))
    now = table(spark, sf_dir, "events").select(named.alias("id"), F.lit(None).cast("string").alias("canonical_hash"), F.lit("now").alias("status")).distinct()
    return replay.clusters_as_of(now, archive(spark, sf_dir).paths, _decision_log(spark, sf_dir), 6000)


@query("d10_last_relocation", _LOG + "SELECT id, action FROM live WHERE action = 'apply_move' ORDER BY id DESC LIMIT 1", False)
def d10_last_relocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.last_relocation(_log(spark, sf_dir)).select("id", "action")


@query("d11_duplicates_to_move", "SELECT p.id AS path_id, p.hash, p.path AS rel, size, root_path AS src_root, drives.label AS src_drive_label FROM paths p JOIN files USING (hash) JOIN drives ON drives.id = p.drive_id WHERE p.status = 'purgatory' AND drives.kind = 'scanned'")
def d11_duplicates_to_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return moves.duplicates_to_move(a.paths, a.files, a.drives)


def _moves(a) -> DataFrame:
    return a.paths.select(F.col("id"), F.col("id").alias("path_id"), "hash", F.when(F.col("id") % 3 == 0, "dup").otherwise("keeper").alias("kind"), F.lit("/dest").alias("dest_root"), F.when(F.col("id") % 4 == 0, "pending").otherwise("executed").alias("status"))


@query("j6_pending_moves", """SELECT p.id, CASE WHEN p.id % 3 = 0 THEN 'dup' ELSE 'keeper' END AS kind, p.path AS rel, p.status AS path_status, size, root_path AS src_root FROM paths p JOIN files USING (hash) JOIN drives ON drives.id = p.drive_id WHERE p.id % 4 = 0""")
def j6_pending_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return moves.pending(_moves(a), a.paths, a.files, a.drives).select("id", "kind", "rel", "path_status", "size", "src_root")


@query("a15_pending_totals", "SELECT CAST(coalesce(sum(CASE WHEN p.id % 3 <> 0 THEN size END), 0) AS BIGINT) AS keeper_bytes, CAST(coalesce(sum(CASE WHEN p.id % 3 = 0 THEN size END), 0) AS BIGINT) AS dup_bytes FROM paths p JOIN files USING (hash) WHERE p.id % 4 = 0")
def a15_pending_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return moves.totals(moves.pending(_moves(a), a.paths, a.files, a.drives))


@query("n20_free_names", """, i AS (SELECT id AS item, '/dest' AS dest_root, lang || '/' || (doc_id % 7) || '.txt' AS rel FROM docs JOIN paths ON paths.id = docs.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY item) AS k FROM i)
SELECT item, dest_root, rel, CASE WHEN k = 1 AND rel <> 'en/1.txt' THEN rel ELSE regexp_replace(rel, '\\.txt$', ' (' || (CASE WHEN rel = 'en/1.txt' THEN k + 1 ELSE k END) || ').txt') END AS final_rel FROM k""")
def n20_free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    items = docs.select(F.col("doc_id").alias("item"), F.lit("/dest").alias("dest_root"), F.concat("lang", F.lit("/"), F.col("doc_id") % 7, F.lit(".txt")).alias("rel"))
    return moves.free_names(items, spark.createDataFrame([("/dest", "en/1.txt")], "dest_root string, rel string"))


@query("m2_verify_sources", """SELECT id AS item, CASE WHEN id % 5 = 0 THEN 'source file is gone' WHEN id % 7 = 0 THEN 'source is a link' WHEN id % 11 = 0 THEN 'source is being written (short read)' WHEN id % 13 = 0 THEN 'content changed since ingest' END AS reason FROM paths""")
def m2_verify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    items = a.paths.join(a.files.select("hash", "size"), "hash").select(F.col("id").alias("item"), F.col("path").alias("abspath"), "hash", "size", "mtime")
    i = F.col("item")
    listing = items.where(i % 5 != 0).select("abspath", (i % 7 == 0).alias("is_link"), (F.col("size") - (i % 11 == 0).cast("int")).alias("size"), "mtime", F.when(i % 13 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return moves.verify_sources(items, listing)


@query("m5_recover", """SELECT outcome, new_status, decision, count(*) AS n FROM (SELECT CASE WHEN d AND NOT s THEN 'commit' WHEN s AND NOT d THEN 'revert' ELSE 'conflict' END AS outcome, CASE WHEN d AND NOT s THEN CASE WHEN k THEN 'active' ELSE 'purgatory' END END AS new_status,
 CASE WHEN d AND NOT s THEN CASE WHEN k THEN 'apply_move' ELSE 'apply_remove' END END AS decision FROM (SELECT event_id % 2 = 0 AS s, event_id % 3 = 0 AS d, event_id % 5 = 0 AS k FROM events)) GROUP BY ALL""", False)
def m5_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    moving = table(spark, sf_dir, "events").select(e.alias("id"), F.when(e % 5 == 0, "keeper").otherwise("dup").alias("kind"), (e % 2 == 0).alias("src_there"), (e % 3 == 0).alias("dst_there"))
    return moves.recover(moving).groupBy("outcome", "new_status", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("s9_managed_drive_ids", "SELECT id, 'managed:' || substr(sha256(root_path), 1, 16) AS managed_id FROM drives")
def s9_managed_drive_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark, sf_dir).drives.select("id", names.managed_drive_id(F.col("root_path")).alias("managed_id"))


@query("d13_fold_files", ", s AS (SELECT hash, size, doc_id FROM docs) SELECT hash, max(size) AS size, min(doc_id) AS first_seen_at, CASE WHEN count(CASE WHEN doc_id % 2 = 0 THEN 1 END) > 0 THEN 'text/plain' END AS mime FROM s GROUP BY hash")
def d13_fold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the observations know no mime type; the fold keeps the known one."""
    seen = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"), F.when(F.col("doc_id") % 2 == 0, "text/plain").alias("mime"), F.col("doc_id").alias("first_seen_at"), F.col("doc_id").alias("seq"))
    return ingest.fold_files(seen.drop("seq").limit(0), seen).select("hash", "size", "first_seen_at", "mime")


@query("f3_listing_blocks", """WITH l AS (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS position, 'dir/' || o_orderkey AS name, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey * 10 END AS size, o_orderkey % 4 = 0 AS is_dir FROM orders)
SELECT * FROM l""", False)
def f3_listing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as the technical listing of an archive, parsed again."""
    k = F.col("o_orderkey")
    block = F.concat(F.lit("Path = dir/"), k, F.when(k % 4 == 0, "\nFolder = +\nSize = \nAttributes = D").otherwise(F.concat(F.lit("\nFolder = -\nSize = "), k * 10, F.lit("\nAttributes = A"))))
    listing = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("b")))).alias("bs"))
    text_of = F.concat(F.lit("Listing archive: a.7z\n\nPath = a.7z\n----------\n"), F.array_join(F.col("bs.b"), "\n\n"), F.lit("\n"))
    return archives.parse_listing(listing.select("o_custkey", text_of.alias("t")), "o_custkey", "t")


@query("x1_daily_activity", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", False)
def x1_daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition: the batch form of the streaming window."""
    return windowed_activity(table(spark, sf_dir, "events")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


# --- the store of the index


@query("s16_merge_on_read", """SELECT id, hash, path, CASE WHEN id % 13 = 0 THEN mtime + 2 WHEN id % 7 = 0 THEN mtime + 1 ELSE mtime END AS mtime, CASE WHEN id % 22 = 0 THEN 'restored' ELSE status END AS status
FROM paths WHERE id % 11 <> 0 OR id % 22 = 0 OR id % 13 = 0""")
def s16_merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths after a base, three rounds of puts and deletes and a compaction between them, as readers of the store see them."""
    paths = archive(spark, sf_dir).paths.withColumn("ctime", F.lit(None).cast("long"))
    i, later = F.col("id"), lambda n: (F.col("mtime") + n).alias("mtime")
    store = Snapshots(spark, scratch_path(spark, "store"))
    store.commit(paths=paths)
    store.commit({"paths": paths.where(i % 7 == 0).withColumn("mtime", later(1))}, {"paths": paths.where(i % 77 == 0).select("id")})
    store.compact("paths")
    store.commit(None, {"paths": paths.where(i % 11 == 0).select("id")})
    store.commit({"paths": paths.where(i % 22 == 0).withColumn("status", F.lit("restored")).withColumn("mtime", F.when(i % 7 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))})
    store.commit({"paths": paths.where(i % 13 == 0).withColumn("mtime", later(2)).withColumn("status", F.when(i % 22 == 0, "restored").otherwise(F.col("status")))})
    return store.table("paths").select("id", "hash", "path", "mtime", "status")
