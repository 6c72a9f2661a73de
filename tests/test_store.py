"""Snapshots, status, images and the inbox."""

import json

import pytest

from pyspark.sql import functions as F

from docloom.operators import images, store
from docloom.operators.embedding import Bigrams, bucket, embed
from docloom.plans import ingest
from docloom.session import ship
from docloom.streaming import inbox

def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def rows(spark, texts):
    data = [(d, i, f"{d}:{i}", d, t) for d, i, t in texts]
    return spark.createDataFrame(data, "doc_id string, block_seq int, block_id string, title string, text string")


def test_upsert_writes_only_what_changed(spark, tmp_path):
    ship(spark)
    s = store.Snapshots(spark, str(tmp_path / "s"))
    first = s.upsert(rows(spark, [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]), embed(), now()).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["stored"], r["skipped"], r["status"]) for r in first] == [("a", 2, 0, "ok"), ("b", 1, 0, "ok")]
    later = F.lit("2026-02-02 00:00:00").cast("timestamp")
    again = s.upsert(rows(spark, [("a", 0, "x"), ("a", 1, "Y"), ("b", 0, "z")]), embed(), later).orderBy("doc_id").collect()
    assert [(r["stored"], r["skipped"], r["status"]) for r in again] == [(1, 1, "ok"), (0, 1, "skipped")]
    kept = {r["block_id"]: str(r["ingested_at"])[:7] for r in s.read().collect()}
    assert kept == {"a:0": "2026-01", "a:1": "2026-02", "b:0": "2026-01"}
    assert s.version() == 2


def test_shrunken_documents_keep_their_tail_unless_rebuilt(spark, tmp_path):
    ship(spark)
    s = store.Snapshots(spark, str(tmp_path / "s"))
    s.upsert(rows(spark, [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]), embed(), now())
    s.upsert(rows(spark, [("a", 0, "x")]), embed(), now())
    assert s.read().count() == 3
    s.upsert(rows(spark, [("a", 0, "x")]), embed(), now(), rebuild=True)
    assert {r["block_id"] for r in s.read().collect()} == {"a:0", "b:0"}
    assert s.delete(["b"]) == 1 and s.read().count() == 1


def test_bigrams():
    assert bucket("ab") == 67
    v = Bigrams()(["abab", "", None])
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-12 and not any(v[1]) and not any(v[2])


def test_backfill_removes_stale_dates(spark):
    df = spark.createDataFrame([("report 2024", "1999", 1999), ("none", "1999", 1999)], "title string, doc_date string, doc_year int")
    got = store.backfilled(df, now()).orderBy("title").collect()
    assert [(r["doc_date"], r["doc_year"]) for r in got] == [(None, None), ("2024", 2024)]


def test_images_are_registered_once(spark, tmp_path):
    df = spark.createDataFrame([("d", "d-1", "png", bytearray(b"abc")), ("d", "d-1", "png", bytearray(b"abc")), ("d", "d-2", "jpg", bytearray(b"x"))], "doc_id string, image_id string, ext string, data binary")
    assert images.save(df, str(tmp_path / "i"), now()).count() == 2
    assert images.save(df, str(tmp_path / "i"), now()).count() == 0
    registry = spark.read.parquet(str(tmp_path / "i" / "registry"))
    found = images.looked_up(spark.createDataFrame([("d-1",), ("no",)], "image_id string"), registry).orderBy("image_id").collect()
    assert [r["rel_path"] for r in found] == ["d/d-1.png", None]


def _inbox(folder):
    (folder / "notes.txt").write_text("one\n\ntwo\n\nthree\n", encoding="utf-8")
    (folder / "m.md").write_text("# T\nbody\n", encoding="utf-8")
    (folder / "p.json").write_text(json.dumps([{"a": 1}, {"a": 2}]), encoding="utf-8")
    (folder / "bad.docx").write_bytes(b"PK\x03\x04 broken")
    (folder / "old.doc").write_bytes(b"\xd0\xcf\x11\xe0")


def test_ingest_twice(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _inbox(folder)
    first = {r["doc_id"]: r for r in ingest.ingest(spark, [str(folder)], str(tmp_path / "s"), now()).collect()}
    assert {k: (r["status"], r["stored"]) for k, r in first.items()} == {"notes": ("ok", 3), "m": ("ok", 1), "p": ("ok", 2), "bad": ("failed", 0), "old": ("failed", 0)}
    again = ingest.ingest(spark, [str(folder)], str(tmp_path / "s"), now())
    second = {r["doc_id"]: r for r in again.collect()}
    assert {k: (r["status"], r["stored"]) for k, r in second.items() if k not in ("bad", "old")} == {"notes": ("skipped", 0), "m": ("skipped", 0), "p": ("skipped", 0)}
    total = store.batch_summary(again).first()
    assert (total["documents"], total["failed"], total["skipped"]) == (5, 2, 3)


def test_inbox_runs_again_without_new_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _inbox(folder)
    args = (spark, str(folder), str(tmp_path / "s"), str(tmp_path / "c"), str(tmp_path / "r"))
    inbox.watch(*args).awaitTermination(120)
    count = store.Snapshots(spark, args[2]).read().count()
    (folder / "more.txt").write_text("new", encoding="utf-8")
    inbox.watch(*args).awaitTermination(120)
    assert store.Snapshots(spark, args[2]).read().count() == count + 1 == 7
    assert inbox.jobs(spark, args[4]).first()["source_file"] == "more.txt"


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    ship(spark)
    s = store.Snapshots(spark, str(tmp_path / "s"), buckets=8)
    s.upsert(rows(spark, [(f"d{i}", 0, f"t{i}") for i in range(40)]), embed(), now())
    before = s.manifest()["buckets"]
    s.upsert(rows(spark, [("new", 0, "n")]), embed(), now())  # only adds: one bucket gains a folder
    added = s.manifest()["buckets"]
    moved = [b for b in added if added[b] != before.get(b)]
    assert len(before) > 4 and len(moved) == 1 and added[moved[0]][:-1] == before.get(moved[0], [])
    s.upsert(rows(spark, [("d3", 0, "changed")]), embed(), now())  # a change: that bucket is written anew
    after = s.manifest()["buckets"]
    moved = [b for b in after if after[b] != added[b]]
    assert len(moved) == 1 and len(after[moved[0]]) == 1
    assert s.read().count() == 41 and s.read(["d3"]).first()["text"] == "changed" and s.read(version=1).count() == 40
    version = s.version()
    s.upsert(rows(spark, [("d3", 0, "changed")]), embed(), now())
    assert s.version() == version  # nothing to write, no version
    assert s.vacuum(older_than=0.0) > 0 and s.read().count() == 41 and s.version() == version


def test_writers_at_once_lose_nothing(spark, tmp_path):
    """4 writers with 120 blocks each."""
    from concurrent.futures import ThreadPoolExecutor

    ship(spark)
    path = str(tmp_path / "s")

    def write(w):
        return store.Snapshots(spark, path, buckets=4).upsert(rows(spark, [(f"w{w}", i, f"text {w} {i}") for i in range(120)]), embed(), now()).collect()

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, range(4)))
    assert [r[0]["stored"] for r in done] == [120] * 4
    s = store.Snapshots(spark, path)
    assert s.read().count() == 480 and s.version() == 4


def test_files_of_one_stem_do_not_mix_at_random(spark):
    df = spark.createDataFrame([("r:0", "a.docx", "x"), ("r:0", "b.pdf", "y"), ("r:1", "a.docx", "z")], "block_id string, source_file string, text string")
    assert {r["block_id"]: r["text"] for r in store.one_a_block(df).collect()} == {"r:0": "y", "r:1": "z"}


def test_listing_is_tolerant(spark, tmp_path):
    from docloom.sources import files

    for name in ("A.TXT", "b.txt", "c.xyz"):
        (tmp_path / name).write_text("t")
    with pytest.warns(UserWarning, match="路径不存在"):
        got = files.read_files(spark, [str(tmp_path), str(tmp_path / "none")])
    assert {r["file_name"]: r["extension"] for r in got.collect()} == {"A.TXT": "txt", "b.txt": "txt"}
    with pytest.warns(UserWarning):
        assert files.read_files(spark, [str(tmp_path / "none")]).count() == 0


def test_busy_models_are_asked_again():
    from docloom.operators import embedding

    seen = []

    def call(error):
        seen.append(1)
        if len(seen) < 3:
            raise error
        return "done"

    assert embedding.tried(lambda: call(embedding.Busy(429)), wait=0) == "done" and len(seen) == 3
    seen.clear()
    with pytest.raises(embedding.Busy):
        embedding.tried(lambda: call(embedding.Busy(400)), wait=0)
    assert len(seen) == 1
