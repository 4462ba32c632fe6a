"""Text, number and label functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts and tokens that say nothing about an image.
GENERIC_ALT = ["image", "img", "photo", "picture", "thumbnail", "thumb", "logo", "icon", "banner", "advertisement", "ad"]
GENERIC_TOKENS = ["image", "img", "photo", "picture", "thumbnail", "art", "untitled"]


def normal(c: Column) -> Column:
    """Trimmed, lower case, runs of white space as one space; null as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def clean(c: Column, max_len: int = 300) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) > max_len, F.concat(F.rtrim(F.substring(t, 1, max_len)), F.lit("..."))).otherwise(t)


def normal_meta(c: Column) -> Column:
    """Letters a-z and digits only, in words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(clean(c, 400)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def slug_path(c: Column, fallback: str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[^a-zA-Z0-9._\-]+", "_"), r"^[._\-]+|[._\-]+$", "")
    return F.when(s == "", fallback).otherwise(s)


def slug_word(c: Column, separator: str = "_") -> Column:
    """Letters and digits of any script, all else one separator."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+", separator)
    return F.regexp_replace(s, rf"^\{separator}+|\{separator}+$", "")


def slug_category(c: Column, fallback: str = "uncategorized") -> Column:
    """ASCII letters, digits, _ and -; all else one underscore."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[^a-zA-Z0-9_\-]+", "_"), r"^_+|_+$", "")
    return F.when(s == "", fallback).otherwise(s)


def slug_site(host: Column, name: Column) -> Column:
    """Host with dashes for dots, two underscores, the name in ASCII letters and digits with dashes between."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.concat(F.replace(F.lower(host), F.lit("."), F.lit("-")), F.lit("__"), F.when(s == "", "site").otherwise(s))


def slug_folder(c: Column) -> Column:
    """Letters and digits of any script and underscores for spaces; all else is left out."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_]", "")


def slug_file(c: Column, kept: str = r"\-_") -> Column:
    """Letters and digits of any script and the signs kept; an underscore for each other character."""
    return F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}{kept}]", "_")


def context_group_key(host: Column, page: Column, name: Column, title: Column, alt: Column) -> Column:
    """Key of the renditions of a picture on a page: its asset signature, else its title or alternative text; null without any."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    signature = asset_signature(blank(name))
    told = normal(F.when(blank(title) != "", title).otherwise(alt))
    head = F.concat(F.lower(F.trim(blank(host))), F.lit("|"), F.lower(F.trim(F.substring_index(blank(page), "#", 1))), F.lit("|"))
    return F.when(signature != "", F.concat(head, F.lit("asset:"), signature)).when(told != "", F.concat(head, F.lit("ctx:"), told))


def meaningful(c: Column, least: int = 8) -> Column:
    t = normal(c)
    return (F.length(t) >= least) & ~t.isin(GENERIC_ALT)


def asset_signature(name: Column) -> Column:
    """Stem of a file without crop and size endings, to group renditions."""
    s = F.regexp_replace(F.lower(F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")), r"\.r_d\.\d+-\d+(?:-\d+)?$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"([_-])\d{2,5}x\d{2,5}$", ""), r"([_-])\d{2,5}([_-])\d{2,5}$", "")
    return F.regexp_replace(s, r"^[._\-]+|[._\-]+$", "")


def merge_classes(a: Column, b: Column) -> Column:
    words = F.filter(F.split(F.concat_ws(" ", a, b), r"\s+"), lambda w: w != "")
    return F.array_join(F.array_distinct(words), " ")


def size_bucket(n_bytes: Column) -> Column:
    return F.when(n_bytes < 10_000, "tiny").when(n_bytes < 50_000, "small").when(n_bytes < 200_000, "medium").otherwise("large")


def aspect_ratio(w: Column, h: Column) -> Column:
    return F.when((F.coalesce(w, F.lit(0)) != 0) & (F.coalesce(h, F.lit(0)) != 0), F.bround(w.cast("double") / h, 4)).otherwise(0.0)


def human_size(n: Column) -> Column:
    d = n.cast("double")
    return (
        F.when(d < 1024, F.format_string("%.1f B", d)).when(d < 1024**2, F.format_string("%.1f KB", d / 1024))
        .when(d < 1024**3, F.format_string("%.1f MB", d / 1024**2)).otherwise(F.format_string("%.1f GB", d / 1024**3))
    )


def megapixel_bucket(w: Column, h: Column) -> Column:
    return F.format_string("%.1fM", F.floor(w.cast("double") * h / 1_000_000).cast("double"))


def upscale(w: Column, h: Column, target: int = 224) -> Column:
    """(ratio, quality, method, concern) of enlarging an image to a square of target pixels."""
    smaller = F.least(w, h)
    ratio = F.when(smaller > 0, F.lit(float(target)) / smaller).otherwise(1.0)
    method = F.when(ratio <= 1.5, "LANCZOS").when(ratio <= 3.0, "BICUBIC").otherwise("BILINEAR")
    return F.struct(ratio.alias("ratio"), (1 / ratio).alias("quality"), method.alias("method"), (ratio > 2.0).alias("concern"))


def ratio_bucket(w: Column, h: Column) -> Column:
    return F.when((w != 0) & (h != 0), F.bround(w.cast("double") / h, 2)).otherwise(0.0)


def dim_bucket(w: Column, h: Column) -> Column:
    r = lambda x: (F.bround(x / 100.0, 0) * 100).cast("int").cast("string")
    return F.concat(r(w), F.lit("x"), r(h))


def image_id(u: Column, day: Column) -> Column:
    return F.md5(F.concat(u, F.coalesce(F.nullif(day, F.lit("")), F.lit("unknown"))))


def hash_hex(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def int_or_null(c: Column) -> Column:
    """A whole number as Python's int reads it, else null."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint"))


def number(c: Column) -> Column:
    """A number, null where it is none or NaN."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def label_of(score: Column, threshold) -> Column:
    """1 from the threshold on; 0 below, and for null or NaN."""
    return F.when(F.coalesce(score, F.lit(float("nan"))).isNotNull() & ~F.isnan(F.coalesce(score, F.lit(float("nan")))) & (score >= threshold), 1).otherwise(0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def prefix_label(name: Column) -> Column:
    return F.when(F.lower(name).startswith("hf_"), 1).when(F.lower(name).startswith("local_"), 0)


def resolve_label(raw: list[Column], mapping: dict[str, str]) -> Column:
    """(label, source): the first value that is not null, mapped where the mapping has it; the source is the place in the list or none."""
    value, at = F.coalesce(*raw), F.coalesce(*[F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(raw)])
    mapped = F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.lower(value)], value) if mapping else value
    return F.struct(mapped.alias("label"), F.coalesce(at.cast("string"), F.lit("none")).alias("source"))


def described(alt: Column, title: Column, host: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(blank(alt), blank(title), F.concat(F.lit("Image from "), host))


def timestamp_of(exif: Column, http: Column) -> Column:
    """The camera's time before the server's."""
    return F.coalesce(F.try_to_timestamp(exif, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(F.regexp_replace(http, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")))


def threshold_column(threshold: float) -> str:
    """Name of the column that holds predictions at a threshold."""
    return "pred_t_" + f"{threshold:g}".replace(".", "_")


def parse_numbers(text: str) -> list[float]:
    """Distinct numbers of a comma list, ascending."""
    return sorted({float(x) for x in text.split(",") if x.strip()})


def parse_years(text: str) -> list[int]:
    """Years of a list with ranges: 2015,2018-2020."""
    out: set[int] = set()
    for part in (p.strip() for p in text.split(",")):
        if "-" in part:
            a, b = map(int, part.split("-"))
            out |= set(range(a, b + 1))
        elif part:
            out.add(int(part))
    return sorted(out)


def parse_label_map(text: str) -> dict[str, str]:
    """a=1,b=0 as a map."""
    return {k.strip().lower(): v.strip() for k, v in (p.split("=", 1) for p in text.split(",") if "=" in p)}


def resolve_split(wanted: str, available: list[str]) -> str:
    """The split asked for, or the usual stand-in where it does not exist."""
    if wanted in available:
        return wanted
    for name in ("test", "validation", "train", *available):
        if name in available:
            return name
    raise ValueError("no split available")


def title_label(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def finite(c: Column, value: float = 0.0) -> Column:
    """A number, with NaN and infinities replaced."""
    inf = float("inf")
    return F.when(F.isnan(c) | (c == inf) | (c == -inf), value).otherwise(c)


def code_points(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
