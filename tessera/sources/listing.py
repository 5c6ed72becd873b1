"""Source listings: safe names, logical paths, warnings; reading files with binaryFile."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources import files

SUFFIXES = ("pdf", "docx", "xlsx")
# What no path component may hold or be.
FORBIDDEN = r'[<>:"|?*\x00-\x1f]'
RESERVED = r"^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"


def unsafe(name: Column) -> Column:
    bad = lambda c: c.isin("", ".", "..") | c.rlike("[ .]$") | c.rlike(FORBIDDEN) | F.upper(F.substring_index(c, ".", 1)).rlike(RESERVED)
    return F.coalesce(name, F.lit("")).isin("") | F.contains(name, F.lit("\\")) | F.exists(F.split(name, "/"), bad)


def logical_path(name: Column, root: str) -> Column:
    """The name below the root, which is not put twice."""
    plain = root.strip("/")
    rest = F.regexp_replace(name, rf"(?i)^\Q{plain}\E(?:/+|$)", "")
    return F.when(rest == "", F.lit(plain)).otherwise(F.concat(F.lit(plain + "/"), rest))


def rooted_path(name: Column, root: str) -> Column:
    """The path from the root's first occurrence on, with forward slashes; null if it is outside or climbs."""
    parts = F.filter(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    at = F.array_position(F.transform(parts, F.lower), F.lit(root.lower()))
    inside = F.slice(parts, F.greatest(at, F.lit(1)).cast("int"), F.size(parts))
    return F.when((at > 0) & ~F.array_contains(inside, ".."), F.array_join(inside, "/"))


def classify(objects: DataFrame, root: str, tie: str) -> DataFrame:
    """Adds logical_path and code: null for good objects, else unsafe_path, unsupported or empty, tested in this order.

    The first good object by name without case takes a logical path; later ones are unsafe (a duplicate destination).
    """
    out = objects.withColumn("logical_path", logical_path(F.col("name"), root)).withColumn("_unsafe", unsafe(F.col("name")))
    out = out.withColumn("_other", ~F.lower("name").rlike(rf"[^/]\.({'|'.join(SUFFIXES)})$"))
    fit = ~F.col("_unsafe") & ~F.col("_other") & (F.col("size") > 0)
    key = F.struct(F.lower("name"), F.col(tie))
    taken = F.min(F.when(fit, key)).over(W.partitionBy(F.lower("logical_path")))
    code = F.when(F.col("_unsafe"), "unsafe_path").when(F.col("_other"), "unsupported").when(F.col("_taken") < key, "unsafe_path").when(F.col("size") == 0, "empty")
    return out.withColumn("_taken", taken).withColumn("code", code).drop("_unsafe", "_other", "_taken")


def scan(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Files below a folder: (path, name, size, content, logical_path, code). Names are listed and files read in tasks (``files.FileSource``); stores that only Spark reads are listed by Spark."""
    if files.readable(path):
        spark.dataSource.register(files.FileSource)
        known = spark.read.format("files").option("suffixes", ",".join(SUFFIXES)).load(path).select("path", "name", "size", "content")
        return classify(known, root, "path")
    return classify(_listed_by_spark(spark, path), root, "path")


def _listed_by_spark(spark: SparkSession, path: str) -> DataFrame:
    """Spark's file sources leave out files without a byte, so these are the listed names that were not read; the names pass through the driver."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # the listing names local files with an empty host, the rows do not
    listed = spark.createDataFrame([(unquote(name).replace("file:///", "file:/", 1),) for name in found.inputFiles()], "path string")
    read = found.select("path", F.col("length").alias("size"), "content")
    empty = listed.join(read.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("size"))
    return read.unionByName(empty, allowMissingColumns=True).withColumn("name", F.substring_index("path", path.rstrip("/") + "/", -1))
