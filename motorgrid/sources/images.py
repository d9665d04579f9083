"""Labelled image trees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorgrid import constants as K


def scan_image_tree(spark: SparkSession, root: str) -> DataFrame:
    """Image files below ``root``: path, class_dir, ext, length and content.

    Rows are kept or dropped by path alone; Spark reads ``content`` only for plans that use it.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").load(root)
    )
    return labelled_files(files, root)


def labelled_files(files: DataFrame, root: str = "") -> DataFrame:
    """Drop hidden and resource-fork entries and files without a class folder."""
    entry = F.regexp_replace("path", r"^file:/+", "/")
    if root:
        base = root.split("://")[-1].rstrip("/") + "/"
        entry = F.regexp_replace(entry, rf"^.*?\Q{base}\E", "")
    bare = F.regexp_replace(
        "entry", "^(?:" + "|".join(K.TREE_PREFIXES) + ")", "")
    return (
        files.withColumn("entry", entry)
        .where(~F.col("entry").rlike(r"(^|/)(\.|__MACOSX/)") & ~F.col("entry").endswith("/"))
        .withColumn("_bare", bare)
        .withColumn("class_dir", F.regexp_extract("_bare", r"(?:^|/)([^/]+)/[^/]+$", 1))
        .withColumn("ext", F.lower(F.regexp_extract("_bare", r"(\.[^./]+)$", 1)))
        .where((F.col("class_dir") != "") & F.col("ext").isin(*K.TREE_EXTENSIONS))
        .drop("_bare")
    )


def write_files(files: DataFrame, root: str) -> int:
    """Write ``content`` (bytes) to ``path`` below ``root``, a URI that all executors reach.

    A file's bytes depend on its row alone and a repeated task writes the same file again. Returns
    the number of files.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                folder = f"{base}/{path}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                with store.open_output_stream(f"{base}/{path}", compression=None) as out:
                    out.write(content.as_py())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    done = files.select("path", "content").mapInArrow(write, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
