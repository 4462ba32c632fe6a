"""Writers: CSV dialects, JSON, one file set per group, key-value tables, and safe rewriting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.functions.text import slug_word


def write_csv(df: DataFrame, path: str, sep: str = "|", mode: str = "overwrite", union_header: bool = False) -> None:
    """CSV with a header; union_header puts the columns in order of their names."""
    (df.select(*sorted(df.columns)) if union_header else df).write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_csv_if_any(df: DataFrame, path: str) -> bool:
    if not df.limit(1).count():
        return False
    write_csv(df, path, ",")
    return True


def append_csv(df: DataFrame, path: str) -> None:
    write_csv(df, path, ",", "append")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_grouped(df: DataFrame, key: str, path: str, fmt: str = "csv") -> None:
    """One folder per group, named by the slug of its key."""
    df.withColumn("group", slug_word(F.col(key))).write.mode("overwrite").partitionBy("group").option("header", True).format(fmt).save(path)


def write_partitioned(df: DataFrame, path: str, keys: list[str], files_per_key: int = 1) -> None:
    """Parquet by keys; rows of a key are spread over files_per_key tasks, so a large key is no single task."""
    salt = F.pmod(F.xxhash64(*df.columns[:1]), F.lit(files_per_key))
    df.withColumn("__salt", salt).repartition(*keys, "__salt").drop("__salt").write.mode("overwrite").partitionBy(*keys).parquet(path)


def evaluation_rows(df: DataFrame, path_col: str) -> DataFrame:
    """The fixed projection (image, split, class) that an evaluation run reads."""
    return df.select(F.col(path_col).alias("image"), F.lit("test").alias("split"), F.lit("1").alias("class"))


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> str:
    """Writes a new version beside path, then swaps the names; returns where the old one is kept (empty if there was none)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.bak"
    df.write.parquet(new)
    p = hadoop.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = ""
    if fs.exists(p):
        fs.delete(hadoop.Path(old), True)
        fs.rename(p, hadoop.Path(old))
        kept = old
    fs.rename(hadoop.Path(new), p)
    return kept


def union_of(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; the columns are those of any, in order of their names."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


#: Columns of a dataset manifest.
MANIFEST = ["filename", "source", "split", "source_relpath", "label_raw"]


def write_manifest(df: DataFrame, path: str) -> None:
    """A manifest of fixed columns; missing ones are empty, others are left out."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in MANIFEST]).write.mode("overwrite").option("header", True).csv(path)


def report(title: str, tables: dict[str, DataFrame], most_rows: int = 50) -> str:
    """A Markdown text of small tables (aggregates): each with its first rows, and a note where there are more."""
    lines = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(most_rows + 1).collect()
        cell = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        lines += ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows[:most_rows]]
        lines += [f"Only the first {most_rows} rows are shown."] * (len(rows) > most_rows) + [""]
    return "\n".join(lines)
