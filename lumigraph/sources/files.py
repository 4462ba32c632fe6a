"""File scans: CSV in its dialects, text lists, JSON folders, image folders as tables of paths."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lumigraph.schemas import SITES, with_defaults


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", root: str | None = None) -> DataFrame:
    """All columns as strings, header first; paths are taken relative to root if one is given."""
    paths = [path] if isinstance(path, str) else path
    paths = [f"{root.rstrip('/')}/{p}" if root else p for p in paths]
    return spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("multiLine", True).option("escape", '"').csv(paths)


def read_csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return read_csv(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Site list, trimmed, missing columns empty, rows without url left out."""
    df = read_csv(spark, path)
    names = [c.split()[0] for c in SITES.split(", ")]
    df = df.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) if c in df.columns else F.lit("").alias(c) for c in names])
    return df.filter("url <> ''")


def read_sites_by_position(spark: SparkSession, path: str) -> DataFrame:
    """First column of a file whatever its header is called."""
    df = read_csv(spark, path)
    return df.select(F.trim(F.col(f"`{df.columns[0]}`")).alias("url")).filter("url <> ''")


def read_seeds(spark: SparkSession, path: str, url: str = "url", category: str = "category", subcategory: str = "subcategory", default_sub: str = "uncategorized") -> DataFrame:
    df = read_csv(spark, path)
    missing = [c for c in (url, category) if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    df = df.select(F.trim(url).alias("url"), F.col(category).alias("category"), (F.col(subcategory) if subcategory in df.columns else F.lit(None).cast("string")).alias("subcategory"))
    return with_defaults(df, {"category": "uncategorized", "subcategory": default_sub}).filter("url <> ''")


def read_url_list(spark: SparkSession, path: str | None, more: list[str] = ()) -> DataFrame:
    """URLs given and of a text file, each once, in order of first mention; lines of # are comments."""
    rows = spark.createDataFrame([(i - len(more), u) for i, u in enumerate(more)], "pos bigint, url string")
    if path:
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("url"))
        rows = rows.unionByName(lines)
    rows = rows.filter("url <> '' and url not like '#%'")
    return rows.groupBy("url").agg(F.min("pos").alias("pos")).select("pos", "url")


def read_downloads(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path).filter("status = 'downloaded' and coalesce(local_path, '') <> ''")


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_json_folder(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object per file; files that don't parse are left out."""
    r = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json")
    return (r.schema(schema) if schema else r).json(path)


def read_merged_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Many CSV files as one table: columns by name, missing ones null, source_file beside."""
    out = None
    for p in paths:
        df = read_csv(spark, p).withColumn("source_file", F.lit(p.rsplit("/", 1)[-1]))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_categories(spark: SparkSession, folder: str, categories: list[str], pattern: str = "{c}/{c}_predictions.csv") -> dict[str, DataFrame]:
    """A table for each category whose CSV exists; a warning for each whose does not."""
    out = {}
    for c in categories:
        path = f"{folder.rstrip('/')}/{pattern.format(c=c)}"
        try:
            out[c] = read_csv(spark, path)
        except AnalysisException:
            warnings.warn(f"no predictions of {c}: {path}", stacklevel=2)
    return out


def archived(files: DataFrame, host: str | None = None, years: list[int] | None = None) -> DataFrame:
    """Files of folders host/year/timestamp, with those parts; host is a part of the name looked for."""
    at = F.transform("parts", lambda p: p.rlike(r"^\d{4}$"))
    i = F.array_position(at, True).cast("int")
    df = files.filter(i > 1).withColumns({"host": F.element_at("parts", i - 1), "year": F.element_at("parts", i).cast("int"), "timestamp": F.get("parts", i)})
    df = df.filter(F.lower("host").contains(host.lower())) if host else df
    return df.filter(F.col("year").isin(years)) if years else df


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The last path of a pattern in order of names."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    names = sorted(f.getPath().toString() for f in found or [])
    return names[-1] if names else None


def resume_state(downloads: DataFrame, name: str = "stored_filename", digest: str = "file_hash") -> tuple[int, DataFrame]:
    """(greatest running number of image_N.ext, distinct hashes already stored)."""
    n = downloads.agg(F.max(F.regexp_extract(name, r"(?i)^image_(\d+)\.[a-z0-9]+$", 1).try_cast("int"))).first()[0]
    return n or 0, downloads.select(digest).filter(F.col(digest) != "").distinct()


def image_files(spark: SparkSession, folder: str, glob: str = "*.{jpg,jpeg,png,webp,bmp,gif,tif,tiff}", content: bool = False) -> DataFrame:
    """(path, length, modificationTime, folder parts) of all image files below a folder; the bytes only on demand."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    cols = ["path", "length", "modificationTime"] + (["content"] if content else [])
    return df.select(*cols, F.split("path", "/").alias("parts"))


def years_of(files: DataFrame) -> DataFrame:
    """Files below a folder named by a year, with that year."""
    return files.withColumn("year", F.filter("parts", lambda p: p.rlike(r"^\d{4}$"))[0].cast("int")).filter("year is not null")


def labelled_files(files: DataFrame, split: str, wanted: list[str] | None = None) -> DataFrame:
    """(image, class, split): class 0 below 0_real, 1 below 1_fake; a path with neither is an error."""
    if wanted:
        files = files.filter(F.arrays_overlap("parts", F.array(*map(F.lit, wanted))))
    label = F.when(F.array_contains("parts", "0_real"), 0).when(F.array_contains("parts", "1_fake"), 1).otherwise(F.raise_error(F.concat(F.lit("no label in path "), "path")).cast("int"))
    return files.select(F.col("path").alias("image"), label.alias("class"), F.lit(split).alias("split"))


def dataset_split(df: DataFrame, split: str) -> tuple[DataFrame, int]:
    """(rows of a split, number of classes of the whole)."""
    return df.filter(F.col("split") == split), df.select("class").distinct().count()


def latest_per(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("__rn = 1").drop("__rn")


def image_table(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels) of all images below a folder that can be decoded."""
    df = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(folder)
    return df.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"))


def image_stats(spark: SparkSession, folder: str) -> DataFrame:
    """image_table with the bytes of each file counted and digested, its aspect ratio, size bucket and number of equal files."""
    from lumigraph.functions.text import aspect_ratio, size_bucket

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"), F.sha1("content").alias("sha1_bytes"))
    same = raw.groupBy("sha1_bytes").agg(F.count("*").alias("duplicate_group_size"))
    both = image_table(spark, folder).join(raw, "path").join(same, "sha1_bytes")
    return both.select("*", aspect_ratio(F.col("width"), F.col("height")).alias("aspect_ratio"), size_bucket(F.col("bytes")).alias("size_bucket"))


def from_lists(spark: SparkSession, lists: dict[str, str], template: str, label: int) -> DataFrame:
    """(image, class, split) from text files of names, one per split; template has {name} and {split}."""
    out = None
    for split, path in lists.items():
        names = spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''")
        df = names.select(F.replace(F.replace(F.lit(template), F.lit("{split}"), F.lit(split)), F.lit("{name}"), F.col("name")).alias("image"), F.lit(label).alias("class"), F.lit(split).alias("split"))
        out = df if out is None else out.unionByName(df)
    return out


def sitemap_entries(xml: DataFrame, url: str = "url", text: str = "xml") -> DataFrame:
    """(url, kind, loc): page addresses of sitemaps and further sitemaps of sitemap indexes."""
    loc = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), 1)).alias("loc")
    return xml.select(F.col(url).alias("url"), F.when(F.col(text).contains("<sitemapindex"), "sitemap").otherwise("page").alias("kind"), loc)
