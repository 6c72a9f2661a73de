"""The image registry: bytes in a folder, one row an image; both kept as they are on a second run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

REGISTRY = "image_id string, doc_id string, rel_path string, ext string, bytes_size int, created_at timestamp"


def registered(images: DataFrame, now: Column) -> DataFrame:
    """Rows of the registry for images (doc_id, image_id, ext, data), one an id."""
    path = F.concat("doc_id", F.lit("/"), "image_id", F.lit("."), "ext")
    return images.dropDuplicates(["image_id"]).select("image_id", "doc_id", path.alias("rel_path"), "ext", F.octet_length("data").alias("bytes_size"), now.alias("created_at"))


def save(images: DataFrame, folder: str, now: Column) -> DataFrame:
    """Writes what is not registered yet: rows to ``folder``/registry, bytes to ``folder``/data by document; returns the new rows.

    Both are Parquet on any file system Spark reaches; files are not opened by path.
    """
    spark = images.sparkSession
    try:
        known = spark.read.parquet(f"{folder}/registry")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], REGISTRY)
    fresh = images.dropDuplicates(["image_id"]).join(known.select("image_id"), "image_id", "left_anti").persist()
    try:
        fresh.select("image_id", "doc_id", "ext", "data").write.mode("append").parquet(f"{folder}/data")
        rows = registered(fresh, now)
        count = fresh.count()
        rows.write.mode("append").parquet(f"{folder}/registry")
    finally:
        fresh.unpersist()
    del count
    return spark.read.parquet(f"{folder}/registry").join(known.select("image_id"), "image_id", "left_anti")


def looked_up(ids: DataFrame, registry: DataFrame) -> DataFrame:
    """ids (image_id) with what is registered of each; null where nothing is."""
    return ids.join(registry.select("image_id", "doc_id", "rel_path", "ext"), "image_id", "left")
