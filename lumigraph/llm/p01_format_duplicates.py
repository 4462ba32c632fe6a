"""Problem 1: records that differ only in formatting, collapsed to one with the number of copies.

Addresses are brought to a canonical form on the JVM side, once: form, 64-bit hash and id are written to the shared
folder. Bloom filters of once- and repeatedly-seen hashes (repeat_filter) are built over the hashes, one group of
segments of the hash space after the other, so that a filter of bounded size is held at any time however many records
there are. Only rows that may repeat are shuffled and grouped exactly, by the canonical text itself; all others are
emitted as singletons where they were read.

Defined results: a null value matches nothing and is a record of its own; values without a letter or digit (blank ones)
are the same record, as nothing but punctuation tells them apart; repeated row_ids count as separate records; an empty
table gives an empty result; columns beside those used are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.llm import repeat_filter
from lumigraph.operators.skew import attach_group_values
from lumigraph.session import persist_shared, table

#: Character references of punctuation and white space, by name and by number.
_AMP = r"(?i)&(?:(?:amp|#0*38|#x0*26);)+"
_EQUALS = r"(?i)&(?:equals|#0*61|#x0*3d);"
_QUESTION = r"(?i)&(?:quest|#0*63|#x0*3f);"
_OTHER = (
    r"(?i)&(?:quot|apos|lt|gt|nbsp|lsquo|rsquo|ldquo|rdquo|laquo|raquo|ndash|mdash|hellip|num|percnt|plus|comma|period|sol|bsol|colon"
    r"|semi|lowbar|lpar|rpar|lsqb|rsqb|lbrack|rbrack|excl|tab|newline|thinsp|ensp|emsp|zwnj|zwj|shy"
    r"|#0*(?:9|1[03]|3[2-9]|4[0-7]|58|59|60|62|64|9[1-6]|12[3-6]|160|171|173|187|82[0-9]{2}|12288)"
    r"|#x0*(?:9|a|d|2[0-9a-f]|3[abce]|40|5[b-f]|60|7[b-e]|a0|ab|ad|bb|20[0-6][0-9a-f]|3000));"
)
#: How many layers of escapes are undone; nested percent signs (%2520) count as one.
LAYERS = 3


def _unescape(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)%(?:25)+([0-9a-f]{2})", "%$1")
    c = F.url_decode(F.regexp_replace(c, r"%(?![0-9a-fA-F]{2})|\+", " "))
    c = F.regexp_replace(c, _AMP, "&")
    c = F.regexp_replace(c, _EQUALS, "=")
    c = F.regexp_replace(c, _QUESTION, "?")
    return F.regexp_replace(c, _OTHER, " ")


#: What every escape holds: a percent or plus sign, or a character reference. A plain & between fields is none.
_ESCAPED = r"[%+]|&#?[A-Za-z0-9]{1,10};"


def unescaped(c: Column, layers: int = LAYERS) -> Column:
    """Percent escapes and character references undone, up to so many layers; plain values skip the work.

    The fold names each layer's result once; written as nested expressions it would be copied into every branch.
    """
    return F.aggregate(F.sequence(F.lit(1), F.lit(layers)), c, lambda x, _: F.when(x.rlike(_ESCAPED), _unescape(x)).otherwise(x))


def letters_and_digits(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", "")


def canonical_address(c: Column) -> Column:
    """Letters and digits of an address in lower case, query fields sorted; null stays null."""


    def key(u: Column) -> Column:
        fields = F.split(F.regexp_replace(F.lower(F.regexp_extract(u, r"(?s)\?(.*)$", 1)), r"[^\p{L}\p{M}\p{N}&;?#]+", ""), "[&;?#]+")
        return F.concat(letters_and_digits(F.regexp_extract(u, r"(?s)^[^?]*", 0)), F.array_join(F.array_sort(fields), ""))

    return F.transform(F.array(unescaped(c)), key)[0]


def possible_repeats(df: DataFrame, key: Column, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may share their key, rows that surely don't), each as (__key, __id); nulls are in neither.

    Keys and hashes are written once; the filters are built from the hashes and tested against them, one group of
    segments at a time (the files of a group are read by themselves).
    """
    spark, n_rows = df.sparkSession, df.count()
    n_segments, n_groups = repeat_filter.plan(n_rows)
    keyed = df.select(key.alias("__key"), F.col(id_col).alias("__id")).filter(F.col("__key").isNotNull())
    keyed = keyed.withColumn("__h", F.xxhash64("__key")).withColumn("__group", repeat_filter.group_of(F.col("__h"), n_segments, n_groups))
    keyed = persist_shared(keyed, "keyed", partition_by="__group" if n_groups > 1 else None)
    maybe = single = None
    for g in range(n_groups):
        own = keyed.filter(F.col("__group") == g) if n_groups > 1 else keyed
        twice = repeat_filter.repeated(own.select("__h"), n_segments)
        marked = own.withColumn("__maybe", repeat_filter.maybe_repeated(spark, F.col("__h"), twice, n_segments))
        hit, no = marked.filter("__maybe").select("__key", "__id"), marked.filter("not __maybe").select("__key", "__id")
        maybe, single = (hit, no) if maybe is None else (maybe.unionAll(hit), single.unionAll(no))
    return maybe, single


def _groups(repeats: DataFrame) -> DataFrame:
    return repeats.groupBy("__key").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))


def collapse(df: DataFrame, key: Column, id_col: str, first: str = "first_row_id", copies: str = "n_copies") -> DataFrame:
    """One row per group of same records: the smallest id and the number of copies (1 for a single record or a null key)."""
    repeats, singles = possible_repeats(df, key, id_col)
    out = _groups(repeats).select(F.col("__first").alias(first), F.col("__n").alias(copies))
    out = out.unionAll(singles.select(F.col("__id").alias(first), F.lit(1).cast("bigint").alias(copies)))
    nulls = df.filter(key.isNull()).select(F.col(id_col).alias(first), F.lit(1).cast("bigint").alias(copies))
    return out.unionAll(nulls)


def copies_of_first(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(first_row_id, copy_row_id) for every record that repeats the one with the smallest id of its group."""
    repeats = persist_shared(possible_repeats(df, key, id_col)[0], "repeats")
    groups = persist_shared(_groups(repeats).filter("__n > 1"), "groups")
    pairs = attach_group_values(repeats, groups, ["__key"], "__n", "__id")
    return pairs.filter("__id <> __first").select(F.col("__first").alias("first_row_id"), F.col("__id").alias("copy_row_id"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies_of_first(table(spark, sf_dir, "images_meta"), canonical_address(F.col("image_url")), "row_id")


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "images_meta"), canonical_address(F.col("image_url")), "row_id")


def _sql_layer(c: str) -> str:
    rx = lambda p, r, x: f"regexp_replace({x}, '{p.removeprefix('(?i)')}', '{r}', 'gi')"
    x = rx("%(?:25)+([0-9a-f]{2})", r"%\1", c)
    x = f"url_decode(replace({x}, '+', ' '))"
    return rx(_OTHER, " ", rx(_QUESTION, "?", rx(_EQUALS, "=", rx(_AMP, "&", x))))


_SQL_KEY = r"""
with l1 as (select row_id, %s as u from images_meta where image_url is not null),
l2 as (select row_id, %s as u from l1), l3 as (select row_id, %s as u from l2),
parts as (select row_id, regexp_replace(lower(regexp_extract(u, '^[^?]*', 0)), '[^\p{L}\p{M}\p{N}]+', '', 'g') as base,
  list_sort(string_split_regex(regexp_replace(lower(case when contains(u, '?') then substr(u, strpos(u, '?') + 1) else '' end), '[^\p{L}\p{M}\p{N}&;?#]+', '', 'g'), '[&;?#]+')) as fields from l3),
keys as (select row_id, base || array_to_string(fields, '') as k from parts)
""" % (_sql_layer("image_url"), _sql_layer("u"), _sql_layer("u"))

QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed}
SQL = {
    "p1_found": _SQL_KEY
    + "select f as first_row_id, row_id as copy_row_id from (select row_id, min(row_id) over (partition by k) as f from keys) where row_id <> f",
    "p1_collapsed": _SQL_KEY
    + "select min(row_id) as first_row_id, count(*) as n_copies from keys group by k union all select row_id, 1 from images_meta where image_url is null",
}
