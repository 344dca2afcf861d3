from __future__ import annotations

import hashlib
import io
import os
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from cairnworks.functions import bits, names, text
from cairnworks.functions.simhash import simhash_arrow, simhash_blake2, simhash_md5
from cairnworks.operators import archives, clusters, diagnostics, ingest, moves, near, review, state, topics
from cairnworks.operators.components import connected_components
from cairnworks.scratch import materialize
from cairnworks.sources import treewalk
from cairnworks.streaming.ingest import FILES, PATHS, index_stream


def one(spark, expr, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expr).collect()]


def test_signature_forms_survive_bit_63(spark):
    sigs = [0, 1, -1, -(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(s,) for s in sigs], "s long").select("s", bits.to_hex(F.col("s")).alias("h"), bits.from_hex(bits.to_hex(F.col("s"))).alias("b"), bits.band(F.col("s"), F.lit(7)).alias("top")).collect()
    for r in rows:
        assert r["h"] == f"{r['s'] & (2**64 - 1):016x}" and r["b"] == r["s"] and r["top"] == (r["s"] & (2**64 - 1)) >> 56


def test_difference_hash(spark):
    pixels = [(9 - c) if r % 2 else c for r in range(8) for c in range(9)]
    want = sum(1 << (r * 8 + c) for r in range(8) for c in range(8) if pixels[r * 9 + c] > pixels[r * 9 + c + 1])
    got = spark.createDataFrame([(pixels,)], "p array<int>").select(bits.difference_hash(F.col("p")).alias("d")).first()["d"]
    assert got & (2**64 - 1) == want


def test_aspects(spark):
    rows = spark.createDataFrame([(220, 100), (145, 100), (115, 100), (87, 100), (69, 100), (45, 100), (44, 100), (0, 3), (None, 3)], "w int, h int")
    assert [r[0] for r in rows.select(bits.aspect_bucket(F.col("w"), F.col("h"))).collect()] == ["pano_wide", "wide", "landscape", "square", "portrait", "tall", "pano_tall", "unknown", "unknown"]


def test_names(spark):
    x = F.col("x")
    stems = one(spark, names.normal_stem(x), "a/notes_v2.md", "notes_FINAL_revised.md", "final.txt", "d/file_001.txt", ".bashrc", "Draft_copy_v10.txt")
    assert stems == ["notes", "notes", "final", "file_001", ".bashrc", "draft"]
    assert one(spark, names.parent_dir(x), "a/b/c.txt", "c.txt", "/c.txt") == ["a/b", ".", "/"]
    assert one(spark, names.suffix(x), "a/B.TXT", ".bashrc", "x", "a.tar.gz") == [".txt", "", "", ".gz"]
    assert one(spark, names.archive_format(x), "A.TAR.GZ", "b.7z", "c") == ["tar", "7z", "?"]
    assert one(spark, names.is_archive(x), "A.tar.zst", "b.JAR", "c.txt") == [True, True, False]
    assert one(spark, names.is_text(x, F.lit(None)), "a.md", "a.bin") == [True, False]
    assert one(spark, names.is_text(x, F.lit("text/x-c")), "a.c") == [True]
    assert one(spark, names.is_image(x, F.lit("image/heic")), "a.heic", "b.PNG") == [True, True]
    assert one(spark, names.mime_type(x), "a.txt", "b.PNG", "c.unknown9", "d") == ["text/plain", "image/png", None, None]
    assert one(spark, names.absolute(F.lit("/r/"), x), "a/b") == ["/r/a/b"] and one(spark, names.absolute(F.lit(None), x), "a/b") == ["a/b"]


def test_text(spark):
    x = F.col("x")
    assert one(spark, text.slug(x), "Kitchen Reno!", "Über Uns!", "日本", "a" * 80) == ["kitchen-reno", "ber-uns", "untitled", "a" * 60]
    assert one(spark, text.heading(x), "\n\n# Title #\nx", "plain\n# No", "#Nospace", "## A", "## AB") == ["Title", None, None, None, "AB"]
    got = one(spark, text.model_answer(x), '{"topic":"T x","confidence":"0.25","kind":"code"}', 'Here: {"topic":"A","slug":"S S"} ok', '{"slug":"q"}', "no json")
    assert [tuple(r) if r else None for r in got] == [("T x", "t-x", "code", 0.25), ("A", "s-s", "other", 0.5), None, None]


def test_simhash_without_words_and_features(spark):
    rows = spark.createDataFrame([(1, ""), (2, "..."), (3, None), (4, "a b c d e")], "k long, t string")
    sigs = {r["k"]: r["sig"] for r in simhash_md5(rows, "k", "t").collect()}
    assert sigs[1] == sigs[2] == sigs[3] == 0 and sigs[4] != 0

    def slow(t, k=4):
        w = t.lower().split()
        grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
        v = [0] * 64
        for g in grams:
            h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big")
            for b in range(64):
                v[b] += 1 if h >> b & 1 else -1
        return sum(1 << b for b in range(64) if v[b] > 0)

    assert simhash_blake2("One two three four five SIX") == slow("one two three four five six") and simhash_blake2("x") == slow("x")


def test_signatures_are_of_whole_texts(spark):
    """What follows 262,144 characters counts, and chunks change nothing."""

    def slow(text, feature):
        words = text.split()
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        hs = [int.from_bytes(feature(g.encode()), "big") for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    md5 = lambda g: hashlib.md5(g).digest()[:8]
    blake2 = lambda g: hashlib.blake2b(g, digest_size=8).digest()
    words = lambda seed, n: " ".join(str(random.Random(seed).getrandbits(40) + i) for i in range(n))
    opening = "same opening " * 21_000
    texts = {"a": opening + words(1, 60_000), "b": opening + words(2, 60_000)} | {f"s{n}": words(3, n) for n in range(1, 14)}
    assert texts["a"][:262_144] == texts["b"][:262_144]
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    plain = {k: slow(t, md5) for k, t in texts.items()}
    got = lambda rows: {r["k"]: r["sig"] & (2**64 - 1) for r in rows.collect()}
    assert got(simhash_md5(df, "k", "t")) == plain and plain["a"] != plain["b"]
    assert got(simhash_md5(df.where("k like 's%'"), "k", "t", chunk=3)) == {k: v for k, v in plain.items() if k[0] == "s"}
    assert got(simhash_arrow(df, "k", "t")) == {k: slow(t, blake2) for k, t in texts.items()}
    assert simhash_blake2(texts["s13"], chunk=3) == slow(texts["s13"], blake2)


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 100 + i) for i in range(40)] + [(900, 900), (1000, 1001), (1000, 1001), (None, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {500: 100, 900: 900, 1000: 1000, 1001: 1000}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_tiles_lose_no_pair(spark):
    r = random.Random(3)
    sigs = [r.getrandbits(64) for _ in range(30)]
    sigs += [s ^ (1 << r.randrange(64)) for s in sigs for _ in range(3)]
    rows = [("b", f"h{i:03d}", s - (1 << 64) if s >> 63 else s) for i, s in enumerate(sigs)]
    got = {(x["a"], x["b"]) for x in near.block_pairs(spark.createDataFrame(rows, "block string, hash string, sig long"), 2, tile=16).collect()}
    want = {(f"h{i:03d}", f"h{j:03d}") for i in range(len(sigs)) for j in range(i + 1, len(sigs)) if bin(sigs[i] ^ sigs[j]).count("1") <= 2}
    assert got == want and got


def test_bands_find_every_close_pair_and_skip_blanks(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(20)]
    sigs = base + [s ^ sum(1 << b for b in r.sample(range(64), 6)) for s in base] + [0, 1, 3]
    rows = [(f"h{i:02d}", "square" if i % 2 else "wide", s - (1 << 64) if s >> 63 else s) for i, s in enumerate(sigs)]
    df = spark.createDataFrame(rows, "hash string, aspect string, sig long")
    good = [i for i in range(len(sigs)) if 8 <= bin(sigs[i]).count("1") <= 56]
    want = {(f"h{i:02d}", f"h{j:02d}") for i in good for j in good if i < j and i % 2 == j % 2 and bin(sigs[i] ^ sigs[j]).count("1") <= 6}
    assert {(x["a"], x["b"]) for x in near.band_pairs(df).collect()} == want and want
    assert near.skipped_buckets(df, cap=1).count() > 0


def test_full_buckets_lose_no_pair(spark):
    """More than 4000 signatures in a bucket, and copies in several tiles."""
    r = random.Random(6)
    sig = lambda x: x - (1 << 64) if x >> 63 else x
    full = [0x5A | r.getrandbits(56) << 8 for _ in range(4100)]  # one low byte
    full += [s ^ 1 << 63 for s in full[:20]]
    base = r.getrandbits(64)
    few = [base] * 40 + [base ^ 1] * 30 + [base ^ 2] + [base ^ (1 << 64) - 1]
    rows = [(f"f{i:04d}", "wide", sig(s)) for i, s in enumerate(full)] + [(f"e{i:02d}", "square", sig(s)) for i, s in enumerate(few)]
    df = materialize(spark.createDataFrame(rows, "hash string, aspect string, sig long"), "test-signatures")
    assert near.skipped_buckets(df.where("aspect = 'wide'")).count() == 1
    wide = {(x["a"], x["b"], x["distance"]) for x in near.band_pairs(df.where("aspect = 'wide'"), bands=1).collect()}
    pops = lambda i, j: bin(full[i] ^ full[j]).count("1")
    assert {(f"f{i:04d}", f"f{4100 + i:04d}", 1) for i in range(20)} <= wide and all(pops(int(a[1:]), int(b[1:])) == d <= 6 for a, b, d in wide)
    square = df.where("aspect = 'square'")
    want = {(f"e{i:02d}", f"e{j:02d}", d) for i in range(72) for j in range(i + 1, 72) if (d := bin(few[i] ^ few[j]).count("1")) <= 6}
    assert {(x["a"], x["b"], x["distance"]) for x in near.band_pairs(square, tile=16).collect()} == want
    groups = {frozenset(x["hs"]) for x in near.components_of(near.band_links(square)).groupBy("component").agg(F.collect_set("hash").alias("hs")).collect()}
    assert groups == {frozenset(f"e{i:02d}" for i in range(71))}


def test_version_chain_is_one_cluster_and_apart_from_noise(spark):
    sig = lambda *on: sum(1 << b for b in on)
    signatures = [("a", sig(*range(20))), ("b", sig(*range(30))), ("c", sig(*range(44))), ("n", sig(*range(20, 64)) - (1 << 64)), ("x", sig(*range(20)))]
    paths = [("a", "d/notes_v1.md", "active"), ("b", "e/notes_v2.md", "active"), ("c", "e/notes_final.md", "active"), ("n", "e/n.md", "active"), ("x", "z/other.md", "active")]
    p = spark.createDataFrame(paths, "hash string, path string, status string")
    s = spark.createDataFrame(signatures, "hash string, sig long")
    none = spark.createDataFrame([], "hash string")
    got = near.document_clusters(p, s, none).collect()
    assert {r["hash"] for r in got} == {"a", "b", "c"} and len({r["cluster_id"] for r in got}) == 1
    assert near.document_clusters(p, s, spark.createDataFrame([("b",)], "hash string")).count() == 0


@pytest.fixture(scope="module")
def small(spark):
    files = spark.createDataFrame([("h1", 10), ("h2", 0), ("h3", 7)], "hash string, size long").withColumn("mime", F.lit("text/plain"))
    paths = spark.createDataFrame([(1, "h1", "d", "a.txt", "active"), (2, "h1", "d", "b.txt", "active"), (3, "h1", "m", "c.txt", "purgatory"), (4, "h2", "d", "e1", "active"), (5, "h2", "d", "e2", "active"), (6, "h3", "d", "z", "purgatory")], "id long, hash string, drive_id string, path string, status string").withColumn("mtime", F.lit(5))
    drives = spark.createDataFrame([("d", "/d", "scanned"), ("m", "/m", "managed")], "id string, root_path string, kind string").withColumn("label", F.col("id"))
    cl = spark.createDataFrame([("c1", "exact", None, "open"), ("c2", "topic", "h3", "resolved")], "id string, kind string, canonical_hash string, status string")
    members = spark.createDataFrame([("c1", "h1"), ("c2", "h1"), ("c2", "h3")], "cluster_id string, hash string")
    return files, paths, drives, cl, members


def test_zero_byte_files_are_no_group(small):
    files, paths, *_ = small
    assert [r["hash"] for r in clusters.exact_groups(files, paths).collect()] == ["h1"]
    assert {r["hash"] for r in clusters.exact_groups(files, paths, 0).collect()} == {"h1", "h2"}


def test_keep_then_undo_is_identity(spark, small):
    files, paths, drives, cl, members = small
    out = review.resolve_keep(cl, members, paths, spark.createDataFrame([("c1", 2), ("c1", 3), ("c9", 1)], "cluster_id string, keep_path_id long"))
    assert {(r["cluster_id"], r["keep_path_id"]) for r in out.rejected.collect()} == {("c1", 3), ("c9", 1)}
    after = review.fold_paths(paths, out.path_changes)
    assert {r["id"]: r["status"] for r in after.collect()}[1] == "purgatory"
    folded = review.fold_clusters(cl, out.cluster_changes)
    assert folded.where("id = 'c1'").first()["canonical_hash"] == "h1"
    back_paths, back_clusters, told = review.undo(out.decisions.withColumn("id", F.lit(7)))
    assert sorted(review.fold_paths(after, back_paths).select("id", "status").collect()) == sorted(paths.select("id", "status").collect())
    assert sorted(map(str, review.fold_clusters(folded, back_clusters).select(*cl.columns).collect())) == sorted(map(str, cl.collect()))
    assert '"target":7' in told.first()["payload"]


def test_restore_guards_and_undo(spark, small):
    files, paths, drives, cl, members = small
    out = review.restore(cl, members, paths, drives, spark.createDataFrame([(1,), (3,), (6,), (99,)], "path_id long"))
    assert {r["path_id"]: r["reason"] for r in out.rejected.collect()} == {1: "not in purgatory", 3: "moved to a managed drive", 99: "no such path"}
    assert [tuple(r) for r in out.path_changes.collect()] == [(6, "active")]
    assert review.fold_clusters(cl, out.cluster_changes).where("id = 'c2'").first()["status"] == "open"
    back, closed, _ = review.undo(out.decisions.withColumn("id", F.lit(1)))
    assert [tuple(r) for r in back.collect()] == [(6, "purgatory")] and closed.first()["canonical_hash"] == "h3"


def test_undo_stack_with_interleaved_undos(spark):
    log = [(1, "resolve_keep", "{}"), (2, "purge_all", "{}"), (3, "undo", '{"target":2}'), (4, "apply_move", "{}"), (5, "undo", '{"target":4}'), (6, "undo", "{}")]
    d = spark.createDataFrame(log, "id long, action string, payload string")
    assert tuple(review.next_undo(d).select("id", "needs_process_undo").first()) == (1, False)
    assert review.next_undo(d.where("id <= 4")).first()["needs_process_undo"] is True
    assert review.next_undo(d.where("id in (2, 3)")).count() == 0 and review.last_relocation(d).count() == 0


def test_deletions_can_be_undone(spark, small):
    paths = small[1]
    left, snapshot = review.deleted_paths(paths, paths.where("id in (1, 4)"), "reconcile_delete")
    again = left.unionByName(review.restored_deletions(snapshot, paths.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")))
    assert sorted(map(tuple, again.select(*paths.columns).collect())) == sorted(map(tuple, paths.collect()))


def test_names_of_one_plan_never_collide(spark):
    items = spark.createDataFrame([(1, "/d", "a.txt"), (2, "/d", "a.txt"), (3, "/d", "a (2).txt"), (4, "/d", "b"), (5, "/e", "a.txt"), (6, "/d", "x/a.txt")], "item long, dest_root string, rel string")
    taken = spark.createDataFrame([("/d", "b"), ("/d", "b (3)")], "dest_root string, rel string")
    got = {r["item"]: r["final_rel"] for r in moves.free_names(items, taken).collect()}
    assert got == {1: "a.txt", 2: "a (3).txt", 3: "a (2).txt", 4: "b (2)", 5: "a.txt", 6: "x/a.txt"}


def test_relocation_plan_and_recovery(spark, small):
    files, paths, drives, *_ = small
    work = moves.pending(spark.createDataFrame([(1, 1, "h1", "keeper", "/dest", "pending")], "id long, path_id long, hash string, kind string, dest_root string, status string"), paths, files, drives)
    plan = moves.plan(work, moves.duplicates_to_move(paths, files, drives), "/hold", spark.createDataFrame([], "dest_root string, rel string"))
    assert sorted((r["item"], r["kind"], r["src"], r["final_rel"]) for r in plan.collect()) == [(1, "keeper", "/d/a.txt", "a.txt"), (6, "dup", "/d/z", "z")]
    table = spark.createDataFrame([(1, "keeper", False, True), (2, "dup", False, True), (3, "dup", True, False), (4, "dup", True, True), (5, "keeper", False, False)], "id long, kind string, src_there boolean, dst_there boolean")
    assert [tuple(r) for r in moves.recover(table).orderBy("id").collect()] == [(1, "commit", "active", "apply_move"), (2, "commit", "purgatory", "apply_remove"), (3, "revert", None, None), (4, "conflict", None, None), (5, "conflict", None, None)]


def test_archives(spark):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("readme.txt", "hello")
        f.writestr("data/a.bin", b"x" * 1000)
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("one.txt")
        info.size = 3
        f.addfile(info, io.BytesIO(b"abc"))
    rows = spark.createDataFrame([("a.zip", bytearray(z.getvalue())), ("b.tar.gz", bytearray(t.getvalue())), ("bad.zip", bytearray(b"nope"))], "path string, content binary")
    totals = {r["path"]: r for r in archives.archive_totals(archives.list_archives(rows)).collect()}
    assert (totals["a.zip"]["entry_count"], totals["a.zip"]["total_size"], totals["a.zip"]["format"]) == (2, 1005, "zip")
    assert (totals["b.tar.gz"]["entry_count"], totals["b.tar.gz"]["total_size"], totals["b.tar.gz"]["format"]) == (1, 3, "tar")
    assert not totals["bad.zip"]["ok"] and totals["bad.zip"]["entry_count"] == 0 and "not readable" in totals["bad.zip"]["error"]


def test_listing_parser(spark):
    listing = "7-Zip\n\nPath = x.7z\nSize = 99\n\n----------\nPath = sub\nFolder = +\nSize = 0\n\nPath = sub/a.txt\nFolder = -\nSize = 1000\nAttributes = A\n\nPath = d\nSize = \nAttributes = D_ drwx\nEncrypted = -\n"
    got = archives.parse_listing(spark.createDataFrame([(1, listing)], "k int, t string"), "k", "t").orderBy("position").collect()
    assert [(r["name"], r["size"], r["is_dir"]) for r in got] == [("sub", 0, True), ("sub/a.txt", 1000, False), ("d", 0, True)]


def test_tree_is_walked_hashed_and_reconciled(spark, tmp_path):
    (tmp_path / "sub/deep").mkdir(parents=True)
    (tmp_path / "managed").mkdir()
    (tmp_path / "a.txt").write_bytes(b"hi")
    (tmp_path / "zero.tmp").write_bytes(b"")
    (tmp_path / "sub/deep/b.txt").write_bytes(b"hi")
    (tmp_path / "managed/m.txt").write_bytes(b"x")
    (tmp_path / treewalk.MARKER).write_text("{}")
    os.symlink(tmp_path / "a.txt", tmp_path / "link.txt")
    seen = treewalk.walk(spark, str(tmp_path), [str(tmp_path / "managed")])
    assert {(r["path"], r["size"], r["is_link"]) for r in seen.collect() if not r["is_link"]} == {("a.txt", 2, False), ("zero.tmp", 0, False), ("sub/deep/b.txt", 2, False)}
    assert [r["path"] for r in seen.where("is_link").collect()] == ["link.txt"]
    hashed = treewalk.hash_files(seen.where("not is_link").withColumn("drive_id", F.lit("d")))
    good, errors = ingest.short_reads(hashed)
    assert {r["path"]: r["hash"] for r in good.collect()}["zero.tmp"] == hashlib.sha256(b"").hexdigest() and errors.count() == 0
    grown = hashed.withColumn("size", F.when(F.col("path") == "a.txt", F.col("size") + 5).otherwise(F.col("size")))
    good, errors = ingest.short_reads(grown)
    assert good.count() == 2 and "short_read" in errors.first()["error"]
    paths = hashed.select(F.monotonically_increasing_id().alias("id"), "drive_id", "path", "hash", F.lit("active").alias("status"))
    drives = spark.createDataFrame([("d", "L", "scanned"), ("m", "M", "managed"), ("u", "U", "scanned")], "id string, label string, kind string")
    up = spark.createDataFrame([("d",)], "drive_id string")
    kept = [(r["drive_id"], r["path"]) for r in paths.collect()]
    (tmp_path / "zero.tmp").unlink()
    stable = spark.createDataFrame([(i, d, p, "h", "active") for i, (d, p) in enumerate(kept)], "id long, drive_id string, path string, hash string, status string")
    listing = treewalk.walk(spark, str(tmp_path)).withColumn("drive_id", F.lit("d"))
    files = spark.createDataFrame([("h", 4)], "hash string, size long")
    lost = ingest.missing_paths(stable, files, drives, listing, up)
    assert [r["path"] for r in lost.collect()] == ["zero.tmp"]
    report = {r["drive_id"]: r for r in ingest.reconcile_report(stable, drives, lost, up).collect()}
    assert (report["d"]["checked"], report["d"]["missing"], report["d"]["sample"]) == (3, 1, ["zero.tmp"])
    assert report["m"]["skipped_managed"] and report["u"]["root_unreachable"]


def test_observation_keeps_purgatory(spark):
    old = spark.createDataFrame([("d", "p", "h1", 1, 10, "purgatory")], "drive_id string, path string, hash string, mtime long, observed_at long, status string")
    seen = spark.createDataFrame([("d", "p", "h2", 2, 20, 1), ("d", "q", "h3", 3, 20, 1)], "drive_id string, path string, hash string, mtime long, observed_at long, seq long")
    got = {r["path"]: (r["hash"], r["status"]) for r in ingest.fold_paths(old, seen).collect()}
    assert got == {"p": ("h2", "purgatory"), "q": ("h3", "active")}


def test_latest_row_wins_and_tombstones_go(spark):
    log = spark.createDataFrame([("a", 1, "put", "x"), ("a", 2, "put", "y"), ("b", 1, "put", "z"), ("b", 2, "delete", None)], "k string, seq int, op string, v string")
    assert [tuple(r) for r in state.latest(log, ["k"], "seq").select("k", "v").collect()] == [("a", "y")]


def test_models_answer_through_a_callable(spark):
    rows = spark.createDataFrame([("h1", "text"), ("h2", "bad")], "hash string, text string")
    make = lambda: lambda t: '{"topic":"Garden","confidence":0.8}' if t == "text" else "sorry"
    tags = topics.as_tags(topics.infer_by_model(rows, "hash", "text", make), "llm")
    assert {(r["key"], r["value"]) for r in tags.collect()} == {("topic", "Garden"), ("topic_slug", "garden"), ("topic_file_kind", "other")}
    locations = spark.createDataFrame([("h1", "a.txt", None), ("h2", "b.txt", None), ("h3", "c.bin", None)], "hash string, rel string, mime string")
    assert [r["hash"] for r in topics.untagged_texts(locations, tags).collect()] == ["h2"]


def test_stream_of_observations_equals_one_batch(spark, tmp_path):
    rows = [("d", f"p{i % 5}", f"h{i}", i, "text/plain" if i % 2 else None, i, 100 + i) for i in range(20)]
    schema = "drive_id string, path string, hash string, size long, mime string, mtime long, observed_at long"
    for part in (rows[:8], rows[8:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    index_stream(stream, f"{tmp_path}/index", f"{tmp_path}/checkpoint").awaitTermination(120)
    last = max(int(p.split("-")[1]) for p in os.listdir(f"{tmp_path}/index") if p.startswith("files-"))
    paths = spark.read.schema(PATHS).parquet(f"{tmp_path}/index/paths-{last}")
    files = spark.read.schema(FILES).parquet(f"{tmp_path}/index/files-{last}")
    assert {r["path"]: r["hash"] for r in paths.collect()} == {f"p{i}": f"h{15 + i}" for i in range(5)} and files.count() == 20


def test_verdicts_of_stored_hashes(spark):
    files = spark.createDataFrame([(h, 3) for h in "abcdef"], "hash string, size long")
    paths = spark.createDataFrame([(1, "a", "active"), (2, "a", "active"), (3, "b", "active"), (4, "b", "active"), (5, "c", "active"), (6, "d", "active"), (7, "e", "active"), (8, "e", "active"), (9, "f", "purgatory")], "id long, hash string, status string")
    disk = spark.createDataFrame([(1, 3, "a"), (2, 3, "a"), (3, 3, "b"), (4, 2, None), (5, 3, "x"), (7, 3, "e"), (8, 3, None)], "id long, disk_size long, fresh_hash string")
    found = {r["hash"]: r["verdict"] for r in diagnostics.exact_verdicts(files, paths, disk).collect()}
    assert found == {"a": "identical", "b": "sizes differ", "c": "changed", "d": "missing", "e": "not hashed"}
    assert diagnostics.hash_prefix(files, "%").count() == 0 and diagnostics.hash_prefix(files, "b").count() == 1
