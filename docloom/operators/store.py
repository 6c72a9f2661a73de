"""The block store: versioned snapshots with incremental upsert by fingerprint.

Blocks lie in buckets by the hash of their document.  Every upsert writes one folder
of Parquet files, a subfolder a bucket, and then a manifest that lists the folders of
each bucket.  Buckets that only gain blocks gain a folder; a bucket in which rows
change or go, or that has ``MOST_PARTS`` folders, is written anew; all others keep
their files.  Readers see a version whole or not at all, and those who ask for some
documents open only their buckets.

A manifest is created once and never replaced: a writer that finds the next number
taken reads that version and tries again on it, so no update of another is lost.
Old versions stay readable until :meth:`Snapshots.vacuum`.

A block whose md5 is unchanged keeps its row (embedding, metadata and time); new and
changed blocks are embedded and written.  Blocks are never deleted by an upsert;
``rebuild`` drops the blocks of given documents in the same version that brings their
new ones.  Of incoming rows with one block_id that of the last source file holds.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from docloom.functions.text import doc_date, doc_year, fingerprint
from docloom.session import Workspace, delete

#: Buckets of a new store; folders of a bucket; tries of a writer among others.
BUCKETS, MOST_PARTS, TRIES = 256, 16, 100


def classified(incoming: DataFrame, stored: DataFrame, key: str = "block_id") -> DataFrame:
    """incoming with md5 and change: skipped, added or changed.  One left join; only two columns of the store are read."""
    known = stored.select(F.col(key), F.col("md5").alias("_old"))
    rows = incoming.withColumn("md5", fingerprint(F.col("text")))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_old") == F.col("md5"), "skipped").otherwise("changed")
    return rows.join(known, key, "left").withColumn("change", change).drop("_old")


def status(failed: Column, chunks: Column, stored: Column) -> Column:
    """failed, skipped (no blocks, or none that changed) or ok."""
    return F.when(failed, "failed").when((chunks == 0) | (stored == 0), "skipped").otherwise("ok")


def report(changes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: blocks, stored, skipped, and its status."""
    counts = changes.groupBy(doc).agg(F.count("*").alias("chunks"), F.count_if(F.col("change") != "skipped").alias("stored"), F.count_if(F.col("change") == "skipped").alias("skipped"))
    return counts.withColumn("status", status(F.lit(False), F.col("chunks"), F.col("stored")))


def batch_summary(reports: DataFrame) -> DataFrame:
    """One row over all reports: documents, those of each status, and blocks stored and skipped."""
    return reports.agg(
        F.count("*").alias("documents"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "skipped", "failed")],
        F.coalesce(F.sum("stored"), F.lit(0)).alias("blocks_stored"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("blocks_skipped"),
    )


def backfilled(stored: DataFrame, now: Column) -> DataFrame:
    """Metadata filled in again from the titles, without a new embedding; stale dates go."""
    date = doc_date(F.col("title"))
    return stored.withColumns({"doc_date": date, "doc_year": doc_year(date), "ingested_at": now})


def with_new_images(known: DataFrame, images: DataFrame) -> DataFrame:
    """Rows of ``images`` (image_id ...) not registered yet, one an id."""
    return images.dropDuplicates(["image_id"]).join(known.select("image_id"), "image_id", "left_anti")


def where_equal(blocks: DataFrame, **values) -> DataFrame:
    """The blocks that have all these values; pushed down to the files."""
    for name, value in values.items():
        blocks = blocks.where(F.col(name) == value)
    return blocks


def counts(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, blocks): how many blocks each document has."""
    return blocks.groupBy(by).agg(F.count("*").alias("blocks"))


def without(blocks: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The blocks of all but these documents."""
    return blocks.join(docs.select(key), key, "left_anti")


def one_a_block(incoming: DataFrame) -> DataFrame:
    """Of rows with one block_id that of the last source file, or of the last fingerprint."""
    order = [F.desc("source_file")] if "source_file" in incoming.columns else []
    nth = F.row_number().over(W.partitionBy("block_id").orderBy(*order, F.desc(fingerprint(F.col("text")))))
    return incoming.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


class Snapshots:
    """A store on any file system Spark reaches on which a rename to a name that is taken fails."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- manifests

    def _numbers(self) -> list[int]:
        at = self._at(f"{self.path}/_versions")
        if not self._fs.exists(at):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(at))
        return sorted(int(n.removeprefix("v")) for n in names if n.startswith("v"))

    def version(self) -> int:
        """The newest version, 0 for none."""
        return max(self._numbers(), default=0)

    def manifest(self, n: int | None = None) -> dict:
        """version, schema, and for each bucket (as text) the folders that hold it; a new store's is empty."""
        n = self.version() if n is None else n
        if not n:
            return {"version": 0, "count": self.buckets, "schema": None, "buckets": {}}
        stream = self._fs.open(self._at(f"{self.path}/_versions/v{n:09d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> bool:
        """Whether the manifest is now the version after the one it was made from; false if another writer was first."""
        folder = f"{self.path}/_versions"
        temporary, name = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/v{manifest['version']:09d}"
        stream = self._fs.create(self._at(temporary), False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        try:
            if self._fs.getScheme() == "file":  # a local rename replaces; a link does not
                bare = lambda p: self._at(p).toUri().getPath()
                os.link(bare(temporary), bare(name))
                return True
            return bool(self._fs.rename(self._at(temporary), self._at(name)))
        except FileExistsError:
            return False
        finally:
            delete(self.spark, temporary)

    # ---- rows

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(manifest["count"])).cast("int")

    def _rows(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame | None:
        """The rows of these buckets, or of all; None for a store without any version."""
        if manifest["schema"] is None:
            return None
        schema = T.StructType.fromJson(manifest["schema"])
        parts = [f"{self.path}/data/{part}/bucket={b}" for b, own in manifest["buckets"].items() if buckets is None or int(b) in buckets for part in own]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def read(self, docs: list[str] | None = None, version: int | None = None) -> DataFrame | None:
        """All blocks, or those of some documents, whose buckets alone are read; None for no version."""
        manifest = self.manifest(version)
        if docs is None:
            return self._rows(manifest)
        asked = self.spark.createDataFrame([(str(d),) for d in docs], "doc_id string").select(self._bucket(manifest).alias("b")).distinct()
        rows = self._rows(manifest, {r["b"] for r in asked.collect()})
        return None if rows is None else rows.where(F.col("doc_id").isin(docs))

    def _write(self, rows: DataFrame, manifest: dict, anew: set[int], touched: set[int]) -> tuple[str, dict]:
        """A folder with rows by bucket, and the manifest of the next version with it; the buckets ``anew`` have nothing else."""
        part = uuid.uuid4().hex[:16]
        rows.withColumn("bucket", self._bucket(manifest)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{part}")
        folder = self._at(f"{self.path}/data/{part}")
        there = {int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(folder) if f.getPath().getName().startswith("bucket=")}
        buckets = {b: own for b, own in manifest["buckets"].items() if int(b) not in anew}
        for b in sorted(there & (touched | anew)):
            buckets[str(b)] = [*buckets.get(str(b), []), part]
        return part, manifest | {"version": manifest["version"] + 1, "buckets": buckets, "schema": manifest["schema"] or json.loads(rows.schema.json())}

    def upsert(self, incoming: DataFrame, embed, now: Column, rebuild: bool = False) -> DataFrame:
        """Writes the next version, if there is anything to write, and returns the report of each document.

        embed: a function from a text column to the embedding column; it sees only
        new and changed texts.  rebuild: the stored blocks of these documents that
        don't come again go, in the same version.
        """
        work = Workspace(self.spark, "upsert")
        incoming = work.save(one_a_block(incoming), "incoming", keep=True)
        for _ in range(TRIES):
            manifest = self.manifest()
            bucket = self._bucket(manifest)
            touched = {r["b"] for r in incoming.select(bucket.alias("b")).distinct().collect()}
            stored = self._rows(manifest, touched)
            if stored is None:
                stored = incoming.limit(0).withColumns({"md5": F.lit(""), "ingested_at": now, "embedding": embed(F.col("text"))})
            changes = classified(incoming, stored)
            fresh = changes.where("change <> 'skipped'").withColumns({"ingested_at": now, "embedding": embed(F.col("text"))})
            fresh = work.save(fresh.select(*stored.columns, "change"), "fresh")
            reports = work.save(report(changes), "reports", keep=True)
            kinds = fresh.groupBy(bucket.alias("b")).agg(F.count_if(F.col("change") == "changed").alias("changed")).collect()
            anew = {r["b"] for r in kinds if r["changed"] or len(manifest["buckets"].get(str(r["b"]), ())) >= MOST_PARTS}
            if rebuild:
                gone = stored.join(incoming.select("doc_id").distinct(), "doc_id", "left_semi").join(incoming.select("block_id"), "block_id", "left_anti")
                gone = work.save(gone.select("doc_id", "block_id"), "gone")
                anew |= {r["b"] for r in gone.select(bucket.alias("b")).distinct().collect()}
            rows = fresh.drop("change")
            if anew:
                same = self._rows(manifest, anew).join(fresh.select("block_id"), "block_id", "left_anti")
                same = same.join(gone.select("block_id"), "block_id", "left_anti") if rebuild else same
                rows = same.select(*rows.columns).unionByName(rows)
            if not kinds and not anew and manifest["version"]:
                return reports
            part, following = self._write(rows, manifest, anew, {r["b"] for r in kinds})
            if self._commit(following):
                # Reports stay in the shared folder until the application ends or calls session.release.
                return reports
            delete(self.spark, f"{self.path}/data/{part}")
        raise RuntimeError(f"other writers were first {TRIES} times")

    def delete(self, docs: list[str]) -> int:
        """A version without the blocks of these documents; how many went."""
        for _ in range(TRIES):
            manifest, asked = self.manifest(), self.read(docs)
            gone = {r["b"]: r["n"] for r in asked.groupBy(self._bucket(manifest).alias("b")).agg(F.count("*").alias("n")).collect()} if asked is not None else {}
            if not gone:
                return 0
            part, following = self._write(self._rows(manifest, set(gone)).where(~F.col("doc_id").isin(docs)), manifest, set(gone), set())
            if self._commit(following):
                return sum(gone.values())
            delete(self.spark, f"{self.path}/data/{part}")
        raise RuntimeError(f"other writers were first {TRIES} times")

    def vacuum(self, keep: int = 1, older_than: float = 86_400.0) -> int:
        """Deletes all but the newest ``keep`` versions, and buckets' folders that none of these lists and that are older than so many seconds; how many folders went.

        The age protects what a writer has not committed yet.
        """
        numbers = self._numbers()
        held = {(part, f"bucket={b}") for n in numbers[-keep:] for b, own in self.manifest(n)["buckets"].items() for part in own}
        for n in numbers[:-keep]:
            delete(self.spark, f"{self.path}/_versions/v{n:09d}")
        data, gone = self._at(f"{self.path}/data"), 0
        for part in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if part.getModificationTime() / 1000 > time.time() - older_than:
                continue
            name = part.getPath().getName()
            buckets = [f.getPath() for f in self._fs.listStatus(part.getPath()) if f.getPath().getName().startswith("bucket=")]
            lost = [f for f in buckets if (name, f.getName()) not in held]
            for f in lost if len(lost) < len(buckets) else [part.getPath()]:
                self._fs.delete(f, True)
            gone += len(lost)
        return gone
