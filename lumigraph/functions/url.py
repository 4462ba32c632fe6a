"""URL functions as Columns: everything stays in the JVM and inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second-level labels below a country code, and tracking parameters.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "ltd", "me", "net", "org", "plc", "sch"]
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref", "referrer", "source", "fbclid", "gclid", "mc_eid"]
#: Path parts that raise or lower the priority of a link.
HIGH_PRIORITY = ["/article/", "/post/", "/blog/", "/news/", "/story/", "/product/", "/item/", "/detail/", "/media/", "/gallery/"]
LOW_PRIORITY = ["/login", "/signup", "/register", "/logout", "/account", "/profile", "/terms", "/privacy", "/cookies", "/legal", "/status", "/health", "/api-docs"]
#: Image file extensions in the order they are tried, and extensions a safe file name keeps.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff", ".tif", ".gif"]
SAFE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico"]

WAYBACK = "https://web.archive.org/web/"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def stripped(u: Column) -> Column:
    """An address without white space around it, and without the line ends and tabs inside that parsers of addresses pass over."""
    space = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    return F.regexp_replace(F.regexp_replace(u, rf"^{space}|{space}\z", ""), r"[\t\r\n]", "")


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SCHEME, 1))


def netloc(u: Column) -> Column:
    """Authority with user info and port, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(u, _NETLOC, 1))


def path(u: Column) -> Column:
    return F.regexp_extract(u, _PATH, 1)


def query_string(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def domain_slug(u: Column) -> Column:
    return F.regexp_replace(netloc(u), r"[.\-]", "_")


def registrable_domain(host: Column) -> Column:
    """Last two labels, or three below a country code with a common second level."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(host), r"^\.+|\.+$", ""), r"\."), lambda p: p != "")
    n = F.size(parts)
    long = (n > 2) & (F.length(F.element_at(parts, -1)) == 2) & F.get(parts, n - 2).isin(SECOND_LEVEL)
    return F.when(n == 0, "").when(n <= 2, F.array_join(parts, ".")).when(long, F.array_join(F.slice(parts, n - 2, 3), ".")).otherwise(F.array_join(F.slice(parts, n - 1, 2), "."))


def strip_www_anywhere(host: Column) -> Column:
    return F.replace(host, F.lit("www."), F.lit(""))


def same_site(a: Column, b: Column) -> Column:
    """Hosts equal but for case and a leading www."""
    bare = lambda h: F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), r"^www\.", "")
    return bare(a) == bare(b)


def host_allowed(host: Column, domain: Column) -> Column:
    """The domain itself or a subdomain of it."""
    h, d = (F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"^\.+|\.+$", "") for x in (host, domain))
    return (h != "") & ((h == d) | h.endswith(F.concat(F.lit("."), d)))


def canonical_page(u: Column) -> Column:
    """Without query, fragment and closing slashes; a bare host gets one slash."""
    p = path(u)
    head = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?", 0)
    return F.concat(head, F.when((p == "") | (p == "/"), "/").otherwise(F.regexp_replace(p, r"/+$", "")))


def normalise_link(u: Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(u), F.lit(" "), F.lit("%20")), r"#.*$", "")


def normalise_url(u: Column) -> Column:
    """https where no scheme is given, host in lower case, no fragment, no tracking parameters; order and repeats stay."""
    full = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))
    fields = F.filter(F.split(query_string(full), "&"), lambda f: (f != "") & ~F.lower(F.substring_index(f, "=", 1)).isin(TRACKING_PARAMS))
    fields = F.transform(fields, lambda f: F.when(f.contains("="), f).otherwise(F.concat(f, F.lit("="))))
    q = F.array_join(fields, "&")
    return F.concat(scheme(full), F.lit("://"), netloc(full), path(full), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def without_dots(p: Column) -> Column:
    """A path from the root without "." and ".." segments; ".." at the root stays there."""

    def fold(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        kept = F.aggregate(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
            lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
        )
        return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))

    return F.when(p.rlike(r"/\.{1,2}(?:/|$)"), F.transform(F.array(F.split(p, "/")), fold)[0]).otherwise(p)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a reference as RFC 3986 has it, in the JVM."""
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    own, rest = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"^[^?#]*([\s\S]*)$", 1)
    return (
        F.when(F.coalesce(href, F.lit("")) == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, without_dots(own), rest))
        .when(href.startswith("?"), F.concat(origin, path(base), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(origin, without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), own)), rest))
    )


def wayback_build(ts: Column, original: Column, flag: str = "id_") -> Column:
    return F.concat(F.lit(WAYBACK), ts, F.lit(f"{flag}/"), original)


def wayback_original(u: Column, host: str = r"web\.archive\.org") -> Column:
    """The address inside an archive address; anything else is returned as it is."""
    inner = F.regexp_extract(u, rf"{host}/web/\d{{14}}[a-z_]*/(https?://[\s\S]*)$", 1)
    return F.when(inner != "", inner).otherwise(u)


def wayback_base(u: Column) -> Column:
    """The archive address up to the address inside, which links of an archived page are put behind; null if it is none."""
    return F.nullif(F.regexp_extract(u, r"^(https?://web\.archive\.org/web/\d{14}[a-z_]*/)", 1), F.lit(""))


def wayback_rewrite(page: Column, href: Column, flag: str | None = None) -> Column:
    """A link of an archived page, resolved against the original page and put behind the page's archive prefix; links into the archive stay."""
    prefix = wayback_base(page) if flag is None else F.regexp_replace(wayback_base(page), r"(\d{14})[a-z_]*/$", f"$1{flag}/")
    full = resolve(wayback_original(page), F.regexp_replace(href, r"^/web/(?=\d{14})", WAYBACK))
    return F.when(prefix.isNull() | full.startswith(WAYBACK), full).otherwise(F.concat(prefix, full))


def wayback_timestamp(u: Column) -> Column:
    return F.nullif(F.regexp_extract(u, r"/web/(\d{14})", 1), F.lit(""))


def link_priority(u: Column) -> Column:
    """Crawl priority, smaller first."""
    p = F.lower(F.when(path(u) == "", "/").otherwise(path(u)))
    depth = F.size(F.filter(F.split(p, "/"), lambda s: s != ""))
    has = lambda hints: F.exists(F.array(*map(F.lit, hints)), lambda h: p.contains(h))
    score = (
        F.lit(40) + F.when(has(LOW_PRIORITY), 20).otherwise(0) - F.when(has(HIGH_PRIORITY), 15).otherwise(0)
        + F.when(depth >= 3, -10).when(depth == 2, -5).when(depth == 0, 15).otherwise(0) - F.when(query_string(u) != "", 5).otherwise(0)
    )
    return F.greatest(F.lit(0), score)


def srcset_entries(srcset: Column, spaced: bool = False) -> Column:
    """Array of (url, descriptor) of a srcset; spaced: only a comma before white space separates."""
    parts = F.filter(F.transform(F.split(F.trim(srcset), r",\s+" if spaced else ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.split(x, r"\s+")[0].alias("url"), F.when(F.size(F.split(x, r"\s+")) > 1, F.element_at(F.split(x, r"\s+"), -1)).alias("d")))


def srcset_best(srcset: Column, dialect: str = "a") -> Column:
    """The largest source of a srcset. Dialects: a splits at ', ', b and c at ','; x counts 1000 (c: 500); on ties the last wins (c: the first)."""
    per_x = 500.0 if dialect == "c" else 1000.0

    def score(e: Column) -> Column:
        d = F.lower(F.coalesce(e["d"], F.lit("")))
        n = F.regexp_extract(d, r"^([0-9]+(?:\.[0-9]+)?)[wx]$", 1).try_cast("double")
        return F.coalesce(F.when(d.endswith("x"), n * per_x).otherwise(n), F.lit(0.0))

    entries = F.transform(srcset_entries(srcset, dialect == "a"), lambda e: F.struct(score(e).alias("s"), e["url"].alias("u")))
    better = (lambda x, acc: x["s"] > acc["s"]) if dialect == "c" else (lambda x, acc: x["s"] >= acc["s"])
    best = F.aggregate(entries, F.struct(F.lit(-1.0).alias("s"), F.lit(None).cast("string").alias("u")), lambda acc, x: F.when(better(x, acc), x).otherwise(acc))
    return F.coalesce(best["u"], F.lit("")) if dialect == "c" else best["u"]


def srcset_first(srcset: Column) -> Column:
    return F.split(F.trim(F.split(F.coalesce(srcset, F.lit("")), ",")[0]), " ")[0]


def css_urls(css: Column) -> Column:
    """All url(...) of a style, quotes taken off."""
    return F.transform(F.regexp_extract_all(css, F.lit(r"""url\(\s*['"]?([^'")]+)['"]?\s*\)"""), 1), lambda x: F.trim(x))


def basename(u: Column) -> Column:
    return F.regexp_extract(path(u), r"[^/]*$", 0)


def extension(u: Column) -> Column:
    """Extension of the last path part with its dot, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(basename(u), r"[^.](\.[^.]+)$", 1))


def stem(u: Column) -> Column:
    return F.regexp_replace(basename(u), r"(?<=[^.])\.[^.]+$", "")


def guess_extension(u: Column, content_type: Column) -> Column:
    p, ct = F.lower(path(u)), F.lower(F.coalesce(content_type, F.lit("")))
    by_path = F.coalesce(*[F.when(p.endswith(e), e) for e in IMAGE_EXTENSIONS])
    return F.coalesce(by_path, F.when(ct.contains("png"), ".png").when(ct.contains("webp"), ".webp").when(ct.contains("gif"), ".gif").otherwise(".jpg"))


#: Content types of pictures and their extensions.
TYPE_EXTENSIONS = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif", "image/bmp": ".bmp", "image/tiff": ".tiff"}


def suffix_extension(u: Column, content_type: Column) -> Column:
    """The other way to guess an extension: the suffix of the last path part, else of exactly this content type, else .jpg."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    by_type = F.create_map(*[F.lit(x) for kv in TYPE_EXTENSIONS.items() for x in kv])[kind]
    return F.when(extension(u).isin(IMAGE_EXTENSIONS), extension(u)).otherwise(F.coalesce(by_type, F.lit(".jpg")))


def safe_filename(u: Column) -> Column:
    """Name of at most 80 characters, 12 digits of the address' MD5, the extension; only the digits where there is no image name."""
    digits, name = F.substring(F.md5(u), 1, 12), F.regexp_replace(basename(u), r"[^A-Za-z0-9_.\-]", "_")
    ext = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    bare = F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")
    return F.when(ext.isin(SAFE_EXTENSIONS), F.concat(F.substring(bare, 1, 80), F.lit("_"), digits, ext)).otherwise(F.concat(digits, F.lit(".jpg")))


def safe_stem(page: Column, u: Column, index: Column) -> Column:
    return F.sha1(F.concat_ws("|", page, u, index.cast("string")))


def canonical_key(u: Column) -> Column:
    """SHA-1 of an address without query and fragment; empty for an empty one."""
    bare = F.substring_index(F.substring_index(F.trim(u), "?", 1), "#", 1)
    return F.when(F.coalesce(F.trim(u), F.lit("")) == "", "").otherwise(F.sha1(bare))


def partition_path(sector: Column, site: Column, source: Column, year: Column) -> Column:
    from lumigraph.functions.text import slug_path

    head = F.concat_ws("/", slug_path(sector, "unknown_sector"), slug_path(site, "unknown_site"))
    return F.when((source == "wayback") & year.isNotNull(), F.concat_ws("/", head, F.lit("wayback"), year.cast("string"))).otherwise(F.concat_ws("/", head, F.lit("live")))
