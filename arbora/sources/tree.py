"""File trees as snapshots: one row for each file below a folder, by Spark's own reader."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.entries import STAMP_FIELDS, content_hash, fingerprint, stamp
from .walk import TreeSource


def observed(listing: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """A snapshot out of a listing: folder, path, kind (File, Directory, Symlink), mode with its type bits, target, and the
    STAMP_FIELDS of each; contents (folder, path, body) for the files that must be hashed.

    A listing that has a `hash` needs no contents.  Files without a body have a null hash, links the hash of their target,
    directories none.  Other kinds are left out."""
    rows = listing.filter("kind in ('File', 'Directory', 'Symlink')")
    if contents is None and "hash" in listing.columns:
        rows = rows.withColumn("__hash", F.col("hash"))
    elif contents is not None:
        rows = rows.join(contents.select("folder", "path", content_hash(F.col("body")).alias("__hash")), ["folder", "path"], "left")
    else:
        rows = rows.withColumn("__hash", F.lit(None).cast("string"))
    file, link = F.col("kind") == "File", F.col("kind") == "Symlink"
    return rows.select(
        "folder", "path", "kind", F.when(file, F.col("size")).otherwise(0).cast("long").alias("size"), F.when(file, F.col("__hash")).when(link, content_hash(F.col("target"))).otherwise("").alias("hash"),
        F.when(link, F.col("target")).alias("target"), F.col("mode").bitwiseAND(F.lit(0o777)).cast("int").alias("mode"), fingerprint({f: F.col(f) for f in STAMP_FIELDS}).alias("stamp"),
    )


def walked(spark: SparkSession, root: str, folder: str, content: bool = True, tasks: int = 64) -> DataFrame:
    """The listing of a mounted tree, by walk.TreeSource: for observed(), and with rows of kind Error for what can't be read."""
    spark.dataSource.register(TreeSource)
    return spark.read.format(TreeSource.name()).option("root", root).option("folder", folder).option("content", str(content)).option("tasks", str(tasks)).load()


def failures(listing: DataFrame) -> DataFrame:
    """What a walk couldn't read: scan (its folder), at (the path) and message, for diff.scan_errors."""
    return listing.filter("kind = 'Error'").select(F.col("folder").alias("scan"), F.col("path").alias("at"), F.col("error").alias("message"))


def laid_out(rows: DataFrame, root: str) -> int:
    """Write rows (path, kind, body, target, mode) as a tree below `root`, in tasks; how many there were.  For mounted folders that
    all tasks share; a task that runs again writes the same."""

    def run(pages):
        for page in pages:
            for path, kind, body, target, mode in zip(page["path"], page["kind"], page["body"], page["target"], page["mode"]):
                at = os.path.join(root, path)
                os.makedirs(at if kind == "Directory" else os.path.dirname(at), exist_ok=True)
                if kind == "Symlink":
                    if not os.path.lexists(at):
                        os.symlink(target, at)
                elif kind == "File":
                    with open(at, "wb") as f:
                        f.write(bytes(body or b""))
                if kind != "Symlink":
                    os.chmod(at, int(mode))
            yield page[["path"]]

    return rows.select("path", "kind", F.col("body").cast("binary").alias("body"), "target", "mode").mapInPandas(run, "path string").count()


def with_directories(files: DataFrame) -> DataFrame:
    """A scan's files, and a row for each directory above them (readers list files only)."""
    above = files.select("folder", F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    blank = {"kind": F.lit("Directory"), "size": F.lit(0).cast("long"), "hash": F.lit(""), "target": F.lit(None).cast("string"), "mode": F.lit(0o755), "stamp": F.lit("")}
    return files.unionByName(above.withColumns(blank))


def scan(spark: SparkSession, root: str, folder: str, glob: str = "*", content: bool = True) -> DataFrame:
    """folder, path (relative), kind, size, hash, target, mode, stamp of all files; without content nothing is read and hashes
    are null.  Spark's reader tells sizes and times only: the stamp has these two, the mode is a plain file's; observed() takes
    a listing that knows more."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    files = reader.load(root)
    base = root.split("://")[-1].rstrip("/") + "/"
    path = F.expr(f"substring(path, instr(path, '{base}') + {len(base)})")
    return files.select(
        F.lit(folder).alias("folder"), path.alias("path"), F.lit("File").alias("kind"), F.col("length").alias("size"), (F.sha2("content", 256) if content else F.lit(None).cast("string")).alias("hash"),
        F.lit(None).cast("string").alias("target"), F.lit(0o644).alias("mode"), stamp(F.col("length"), F.unix_micros("modificationTime")).alias("stamp"),
    )


def save(entries: DataFrame, folder: str, version: int) -> str:
    """Write an index as a new version, by folder and in order of paths; older versions stay until they are removed."""
    path = f"{folder}/v={version}"
    entries.repartitionByRange("folder", "path").sortWithinPartitions("folder", "path").write.partitionBy("folder").parquet(path)
    return path


def exported(spark: SparkSession, path: str) -> DataFrame:
    """What save() wrote at `path`, each row with its `position` in its folder, counted through the files as they lie there."""
    rows = spark.read.parquet(path).withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    # A row for each file.
    files = rows.groupBy("folder", "__file").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("folder").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = files.select(F.col("__file").alias("__f"), before.alias("__begin"))
    return rows.join(begin, F.col("__file") == F.col("__f")).withColumn("position", F.col("__begin") + F.col("__row") + 1).drop("__file", "__row", "__f", "__begin")
