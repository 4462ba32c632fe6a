"""References to pictures in whatever form a table has them: address, path, base64, data address, bytes, or a struct of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the parts of a picture struct, and of columns that hold pictures, in the order they are tried.
PARTS = ["path", "bytes", "url"]
IMAGE_NAMES = ["image", "img", "picture", "photo", "image_path", "image_url", "path", "url"]
_IMAGE_TEXT = r"(?i)^data:image/|\.(?:jpe?g|png|webp|gif|bmp|tiff?)(?:[?#].*)?$"


def is_image_type(kind: T.DataType) -> bool:
    """Whether a column of this type holds pictures by its form: bytes, or a struct with a path, bytes or url."""
    return isinstance(kind, T.BinaryType) or isinstance(kind, T.StructType) and any(f.name in PARTS for f in kind.fields)


def image_columns(df: DataFrame) -> list[str]:
    """Columns that hold pictures by their form, in order."""
    return [f.name for f in df.schema.fields if is_image_type(f.dataType)]


def resolve_image_column(df: DataFrame, wanted: str | None = None) -> str:
    """The column asked for; else one with a usual name, else the first that holds pictures."""
    if wanted is not None:
        if wanted not in df.columns:
            raise ValueError(f"no column {wanted}; there are {', '.join(df.columns)}")
        return wanted
    for name in [*IMAGE_NAMES, *image_columns(df)]:
        if name in df.columns:
            return name
    raise ValueError("no column with pictures")


def image_input(c: Column, kind: T.DataType) -> Column:
    """struct(form, ref, content) of a picture column: form is url, path, bytes or null, ref a text and content bytes.

    Texts are told apart by what they look like: an address, a data address or long base64 (both give bytes), else a path.
    """
    none, empty = F.lit(None).cast("string"), F.lit(None).cast("binary")
    made = lambda form, ref, content: F.struct(form.alias("form"), ref.alias("ref"), content.alias("content"))
    if isinstance(kind, T.BinaryType):
        return F.when(F.length(c) > 0, made(F.lit("bytes"), none, c)).otherwise(made(none, none, empty))
    if isinstance(kind, T.StructType):
        names = {f.name: f.dataType for f in kind.fields}
        text = lambda n: F.nullif(F.trim(c[n]), F.lit("")) if isinstance(names.get(n), T.StringType) else none
        content = F.when(F.length(c["bytes"]) > 0, c["bytes"]) if isinstance(names.get("bytes"), T.BinaryType) else empty
        return F.when(text("path").isNotNull(), made(F.lit("path"), text("path"), empty)).when(content.isNotNull(), made(F.lit("bytes"), none, content)).when(text("url").isNotNull(), made(F.lit("url"), text("url"), empty)).otherwise(made(none, none, empty))
    t = F.trim(c)
    base64 = F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)^data:image/[^;,]+;base64,(.*)$", 1), F.lit("")), F.when(t.rlike(r"^[A-Za-z0-9+/\s]{64,}={0,2}$") & ~t.rlike(_IMAGE_TEXT), t))
    decoded = F.try_to_binary(F.regexp_replace(base64, r"\s", ""), F.lit("base64"))
    return F.when(t.rlike(r"(?i)^https?://"), made(F.lit("url"), t, empty)).when(decoded.isNotNull(), made(F.lit("bytes"), none, decoded)).when(t != "", made(F.lit("path"), t, empty)).otherwise(made(none, none, empty))


def sorted_json(c: Column) -> Column:
    """A JSON text in one form: keys of all objects in order, no spaces; null where it is no JSON. The variant type keeps keys sorted."""
    return F.to_json(F.try_parse_json(c))
