"""Writing tables: by series, by group, by run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by(df: DataFrame, path: str, by: Sequence[str] = ("traj_id",), format: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per value, rows of a value gathered first so that no task opens a file in each; hot values are split by AQE."""
    df.hint("rebalance", *(F.col(c) for c in by)).write.mode(mode).partitionBy(*by).format(format).save(path)


def upsert_by(df: DataFrame, path: str, by: Sequence[str] = ("traj_id",), format: str = "parquet") -> None:
    """Replace the folders of the values that df has and leave all others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(format).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_tables(tables: dict[str, DataFrame], folder: str, by_series: bool = True) -> None:
    """Named tables, each below its name; those with a traj_id in folders by series."""
    for name, df in tables.items():
        if by_series and "traj_id" in df.columns:
            write_by(df, f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_cuts(segments: DataFrame, cuts: DataFrame, folder: str, key: Sequence[str] = ("traj_id", "segment_id"), by: Sequence[str] = ("grp",)) -> None:
    """What to inspect of every k: segments with labels, sizes of clusters and silhouettes, in folders by group and k, so that one k is read alone."""
    on = [*(c for c in by if c in cuts.columns and c in segments.columns), *key]
    labelled = segments.drop("cluster_label").join(cuts, on)
    parts = [*(c for c in by if c in labelled.columns), "k"]
    write_by(labelled, f"{folder}/segments", parts)
    sizes = cuts.groupBy(*parts, "cluster_label").agg(F.count("*").alias("n_segments"), F.max("silhouette").alias("silhouette"))
    write_by(sizes, f"{folder}/clusters", parts)


def write_sweep(summary: DataFrame, picked: DataFrame, folder: str) -> None:
    """A penalty sweep and the penalty that it recommends, as CSV."""
    write_csv(summary, f"{folder}/sweep")
    write_csv(picked, f"{folder}/recommended")


def write_states(found: dict[str, DataFrame], settings: dict, folder: str) -> None:
    """A state model's tables, those with a traj_id by series, and its settings as JSON beside them."""
    write_tables(found, folder)
    spark = next(iter(found.values())).sparkSession
    spark.range(1).select(*(F.lit(v).alias(k) for k, v in settings.items())).coalesce(1).write.mode("overwrite").json(f"{folder}/settings")


def write_cohorts(tables: dict[str, DataFrame], folder: str, by: str = "cohort") -> None:
    """Named tables in folders by cohort, so that reading one cohort prunes the others."""
    for name, df in tables.items():
        write_by(df, f"{folder}/{name}", [by])


def replace_source(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Put df in place of a table that it may be read from: written beside it first, then swapped by renaming, so that a failure leaves one of both whole."""
    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    df.write.mode("overwrite").format(format).save(new)
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = lambda x: hadoop.Path(x)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """Atoms as PDB records: traj_id, frame, atom_id, line."""
    line = F.format_string("%-6s%5d %-4s %-3s  %4d    %8.3f%8.3f%8.3f  1.00  0.00          %2s", F.lit("ATOM"), "atom_id", "name", "resname", "resid", F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double"), "element")
    return atoms.select("traj_id", "frame", "atom_id", line.alias("line"))


def write_pdb(atoms: DataFrame, folder: str) -> None:
    """A text file per frame, its atoms in order."""
    each = F.array_sort(F.collect_list(F.struct("atom_id", "line")))
    text = pdb_lines(atoms).groupBy("traj_id", "frame").agg(F.concat(F.array_join(F.transform(each, lambda s: s["line"]), "\n"), F.lit("\nEND")).alias("value"))
    text.write.mode("overwrite").partitionBy("traj_id", "frame").text(folder)
