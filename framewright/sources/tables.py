"""Feature tables and their like: many files, one DataFrame."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import finite_table
from ..functions.labels import cohort, series_id
from ..schemas import require


def stem(path_column=None):
    """The name of the file that a row comes from, without folders and ending."""
    path = path_column if path_column is not None else F.input_file_name()
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")


def read_features(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None, format: str = "csv") -> DataFrame:
    """Feature tables with traj_id and cohort from their files' names where they have none, floats cleaned.

    Paths may be globs and folders. Without a schema CSV types are inferred, which reads
    the files twice; tables of one kind share a schema, so give it.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if format == "csv":
        reader = reader.option("header", "true").option("nanValue", "nan")
        reader = reader.schema(schema) if schema else reader.option("inferSchema", "true")
    elif schema:
        reader = reader.schema(schema)
    df = reader.format(format).load(list(paths) if not isinstance(paths, str) else paths)
    name = stem()
    if "traj_id" not in df.columns:
        df = df.withColumn("traj_id", series_id(name))
    if "cohort" not in df.columns:
        df = df.withColumn("cohort", cohort(name))
    return finite_table(df)


def read_stacked(spark: SparkSession, paths: Sequence[str], format: str = "csv") -> DataFrame:
    """Tables whose columns differ, stacked; what a table lacks is NULL there."""
    parts = [read_features(spark, p, format=format) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def unique_ids(paths: DataFrame, column: str = "path") -> DataFrame:
    """A traj_id per path, from its file's name; the second of a name gets _1, the third _2."""
    base = paths.withColumn("__b", stem(F.col(column)))
    n = F.row_number().over(W.partitionBy("__b").orderBy(column)) - 1
    return base.withColumn("traj_id", F.when(n == 0, F.col("__b")).otherwise(F.concat_ws("_", "__b", n.cast("string")))).drop("__b")


def read_scores(spark: SparkSession, paths: str | Sequence[str], by: str = "overall_score") -> DataFrame:
    """Score tables of runs, best first, with ranks and the files they come from."""
    from ..operators.aggregates import ranked_scores

    df = read_features(spark, paths)
    df = require(df, by).withColumn("source_file", F.input_file_name()) if "source_file" not in df.columns else df
    return ranked_scores(df, by, "source_file")


def read_energy_log(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """A log of numbers between white space; lines that begin with # or hold no number are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    first = parts[0].try_cast("double")
    return rows.where(first.isNotNull()).select(*(F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)))


def read_manifests(spark: SparkSession, path: str, contains: str | None = None, name: str | None = None) -> DataFrame:
    """Run manifests, JSON, those whose text or name holds what is asked for."""
    df = spark.read.option("recursiveFileLookup", "true").option("multiLine", "true").json(path).withColumn("source_file", F.input_file_name())
    if name and "name" in df.columns:
        df = df.where(F.col("name") == name)
    if contains:
        df = df.where(F.to_json(F.struct(*df.columns)).contains(contains))
    return df


def read_site_map(spark: SparkSession, path: str, traj_id: str | None = None) -> DataFrame:
    """Sites with their atom ids as an array; files keep them as text between spaces or bars."""
    df = spark.read.option("header", "true").csv(path)
    if "atom_ids" in df.columns:
        df = df.withColumn("atom_ids", F.transform(F.filter(F.split(F.trim("atom_ids"), r"[\s|]+"), lambda x: x != ""), lambda x: x.cast("int")))
    return df.where(F.col("traj_id") == traj_id) if traj_id else df


def compare_trees(spark: SparkSession, reference: str, candidate: str, rtol: float = 1e-6, atol: float = 1e-9) -> DataFrame:
    """Files below two folders, by their path below it: identical, within (numbers agree to a tolerance, all else is equal), differs or missing, and how many cells differ.

    Files are read whole, as tables of lines of cells; those that are equal byte for byte are not taken apart.
    """

    def below(folder: str, side: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        root = files.agg(F.min("path")).first()[0]
        if root is None:
            return spark.createDataFrame([], f"path string, {side} binary")
        cut = folder.rstrip("/").split("/")[-1]
        rel = F.element_at(F.split("path", f"/{re.escape(cut)}/", 2), 2)
        return files.select(rel.alias("path"), F.col("content").alias(side))

    both = below(reference, "a").join(below(candidate, "b"), "path", "full")
    state = both.select("path", F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "identical").alias("state"), "a", "b")
    lines = lambda c: F.split(F.regexp_replace(F.col(c).cast("string"), "\r", ""), "\n")
    pairs = lambda df: df.select("path", F.explode(F.arrays_zip("a", "b")).alias("z")).select("path", "z.*")
    apart = pairs(state.where("state IS NULL").select("path", lines("a").alias("a"), lines("b").alias("b")))
    split = lambda c: F.split(F.coalesce(c, F.lit("")), ",").alias(c)
    cells = pairs(apart.select("path", split("a"), split("b"))).select("path", F.struct("a", "b").alias("z"))
    x, y = F.col("z.a").try_cast("double"), F.col("z.b").try_cast("double")
    near = F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(x), F.lit(False))
    odd = cells.groupBy("path").agg(F.count_if(~(F.col("z.a").eqNullSafe(F.col("z.b")) | near)).alias("n_cells"))
    joined = state.drop("a", "b").join(odd, "path", "left")
    return joined.select("path", F.coalesce("state", F.when(F.col("n_cells") == 0, "within").otherwise("differs")).alias("state"), F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells"))
