"""Rules that tell content from everything else.

A rule gives a reason (or null) rather than dropping rows, so counts of reasons are one aggregation over the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigraph.functions import text as X
from lumigraph.functions import url as U

#: Keywords of the rules.
UI_KEYWORDS = [
    "icon", "favicon", "sprite", "avatar", "emoji", "badge", "loader", "placeholder", "sticker", "emote", "reaction", "stamp",
    "logo", "menu", "share", "newsletter", "cookie", "consent", "close", "search", "header", "footer", "nav", "button",
]
VIDEO_KEYWORDS = [
    "video", "thumbnail", "thumb", "poster", "trailer", "preview", "playbutton", "play-button", "cover_video", "hqdefault", "mqdefault",
    "maxresdefault", "sddefault", "youtube", "ytimg", "vimeo", "dailymotion", "wistia", "jwplayer", "brightcove",
]
AD_KEYWORDS = ["ad", "ads", "advert", "banner", "sponsored", "promotion", "doubleclick", "googlesyndication", "taboola", "outbrain", "adsystem", "adserver", "adclick", "adslot"]
AD_TEXT_KEYWORDS = [
    "ad", "ads", "advert", "advertise", "advertisement", "banner", "sponsor", "sponsored", "promoted", "doubleclick", "googlesyndication",
    "adservice", "taboola", "outbrain", "criteo", "affiliate", "tracking",
]
AD_HOSTS = [
    "doubleclick.net", "googlesyndication.com", "adservice.google.com", "googletagmanager.com", "taboola.com", "outbrain.com", "criteo.com", "adsrvr.org", "adnxs.com",
]
BLOCKED_KEYWORDS = ["nsfw", "porn", "adult", "nud", "nude", "sex", "gore", "graphic", "violence", "bloody", "illegal", "explicit"]
ICON_KEYWORDS = ["icon", "favicon", "sprite", "badge", "logo", "emoji", "avatar", "app-store", "google-play", "play-badge", "social-icon"]
ICON_TEXTS = ["icon", "logo", "badge", "menu", "search", "close", "next", "previous", "facebook", "instagram", "x", "twitter", "youtube", "tiktok"]
BLOCKED_URL_KEYWORDS = ["logo", "icon", "avatar", "sprite", "favicon", "badge", "placeholder", "loader", "spinner", "pixel", "thumb-default", "profilepic"]
IMAGE_HOSTS = ["staticflickr", "wixmp", "behance", "loc.gov"]
ALLOWED_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff", ".tif"]
NON_HTML = [
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".svg", ".ico", ".pdf", ".zip", ".rar", ".7z", ".tar", ".gz", ".mp4", ".mov", ".avi",
    ".mkv", ".webm", ".mp3", ".wav", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".json", ".xml", ".rss", ".atom",
]
PRIORITY_PATHS = ["news", "blog", "press", "media", "gallery", "about", "story", "article", "report", "publication", "insight"]
#: Banner sizes of the two ad rules.
BANNERS = [(300, 250), (320, 50), (468, 60), (728, 90), (970, 90), (970, 250), (160, 600), (300, 600)]
BANNERS_SCORED = [(300, 250), (320, 50), (336, 280), (468, 60), (728, 90), (970, 90), (970, 250), (160, 600), (300, 600)]
#: Least width and height per site, and the rule of the sites judged by area.
SITE_MIN_DIMENSIONS = {"behance": (320, 240), "deviantart": (280, 200), "loc_pictures": (260, 180)}
AREA_SITES, AREA_MIN_SIDE, AREA_MIN = ["flickr", "flickr_commons"], 180, 70_000
DEFAULT_MIN_DIMENSIONS = (900, 600)


def contains_any(c: Column, words: list[str], word_bounds: bool = False) -> Column:
    """Whether a text in lower case holds any of the words; as parts of words too unless word_bounds."""
    if word_bounds:
        return c.rlike(r"(?<![a-z0-9])(?:" + "|".join(w.replace(".", r"\.") for w in words) + r")(?![a-z0-9])")

    def any_in(x: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | x.contains(w)
        return out

    # many words over a built text: bound once, else its expression is repeated per word and the generated code grows too large
    return F.transform(F.array(c), any_in)[0] if len(words) > 4 else any_in(c)


def joined(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def is_ui_asset(url: Column, *texts: Column) -> Column:
    p = F.lower(U.path(url))
    return contains_any(joined(url, *texts), UI_KEYWORDS) | p.endswith(".svg") | contains_any(p, ["/icons/", "/sprites/", "/logos/"])


def is_video_thumbnail(url: Column, *texts: Column) -> Column:
    named = r"(^|[/_-])(hqdefault|maxresdefault|mqdefault|sddefault|poster|thumbnail|thumb)($|[._-])"
    return contains_any(joined(url, *texts), VIDEO_KEYWORDS) | F.lower(U.path(url)).rlike(named)


def passes_quality(w: Column, h: Column, content_type: Column, n_bytes: Column) -> Column:
    ratio = w.cast("double") / F.greatest(h, F.lit(1))
    return ~content_type.startswith("image/svg") & (w >= 180) & (h >= 180) & (w * h >= 50_000) & (ratio >= 0.33) & (ratio <= 3.0) & (n_bytes >= 4000)


def passes_size(w: Column, h: Column) -> Column:
    return (w >= 100) & (h >= 100) & (w * h >= 10_000) & (w <= 8000) & (h <= 8000)


def valid_download(content_type: Column, n_bytes: Column) -> Column:
    """An image, and of 5 KB to 10 MB where the size is known."""
    return F.lower(F.coalesce(content_type, F.lit(""))).startswith("image/") & (n_bytes.isNull() | ((n_bytes >= 5 * 1024) & (n_bytes <= 10 * 1024 * 1024)))


def quality_reasons(w: Column, h: Column, min_w: int = 256, min_h: int = 256, max_w: int = 8192, max_h: int = 8192, min_mp: float = 0.065, max_mp: float = 50.0) -> Column:
    """Array of the reasons against an image; empty if there is none."""
    mp = w.cast("double") * h / 1e6
    return F.array_compact(F.array(
        F.when((w < min_w) | (h < min_h), "too_small"), F.when((w > max_w) | (h > max_h), "too_large"),
        F.when(mp < min_mp, "insufficient_megapixels"), F.when(mp > max_mp, "excessive_megapixels"),
    ))


def is_ad(texts: list[Column], w: Column, h: Column) -> Column:
    banner = F.lit(False)
    for a, b in BANNERS:
        banner = banner | ((w == a) & (h == b))
    return contains_any(joined(*texts), AD_KEYWORDS) | F.coalesce(banner, F.lit(False))


def ad_score(url: Column, texts: list[Column], w: Column, h: Column) -> Column:
    """(score, reasons): points of the ad rules, and their names joined by |."""
    known = F.coalesce((w != 0) & (h != 0), F.lit(False))
    banner = F.lit(False)
    for a, b in BANNERS_SCORED:
        banner = banner | ((w == a) & (h == b))
    ratio = w.cast("double") / F.greatest(h, F.lit(1))
    rules = [
        ("ad_keyword_match", 2, contains_any(joined(url, *texts), AD_TEXT_KEYWORDS)),
        ("ad_host_match", 3, contains_any(U.netloc(F.coalesce(url, F.lit(""))), AD_HOSTS)),
        ("common_banner_size", 3, known & banner),
        ("extreme_aspect_ratio", 1, known & ((ratio >= 4.0) | (ratio <= 0.25))),
        ("tiny_image", 1, known & (w <= 180) & (h <= 120)),
        ("tracking_query_param", 1, F.lower(F.coalesce(url, F.lit(""))).rlike(r"[?&](utm_|gclid|fbclid|adid|campaign)=")),
    ]
    score = F.lit(0)
    for _, points, hit in rules:
        score = score + F.when(hit, points).otherwise(0)
    return F.struct(score.alias("score"), F.array_join(F.array_compact(F.array(*[F.when(hit, name) for name, _, hit in rules])), "|").alias("reasons"))


def ad_confidence(score: Column, reasons: Column, model: Column | None = None, mode: str = "hybrid") -> Column:
    """Confidence that an image is an ad: the rules' alone, the model's alone, or six to four with a floor of 0.85 on strong reasons."""
    rules = F.least(F.lit(1.0), score / 6.0)
    if mode == "heuristic" or model is None:
        return rules
    if mode == "clip":
        return F.coalesce(model, rules)
    blend = 0.6 * rules + 0.4 * model
    strong = reasons.contains("ad_host_match") | reasons.contains("common_banner_size")
    return F.when(model.isNull(), rules).when(strong, F.greatest(blend, F.lit(0.85))).otherwise(blend)


def is_blocked(url: Column, alt: Column) -> Column:
    return contains_any(joined(url, alt), BLOCKED_KEYWORDS)


def is_icon(url: Column, alt: Column, title: Column) -> Column:
    """Icons; a text of 20 characters and three words makes an image content."""
    told = F.trim(F.concat_ws(" ", X.normal(alt), X.normal(title)))
    rich = (F.length(told) >= 20) & (F.size(F.split(told, r"\s+")) >= 3)
    return ~rich & (told.isin(ICON_TEXTS) | contains_any(F.lower(F.coalesce(url, F.lit(""))), ICON_KEYWORDS))


def valid_image_url(u: Column) -> Column:
    ext = U.extension(u)
    return U.scheme(u).isin("http", "https", "data") & (ext != ".svg") & ((ext == "") | ext.isin(ALLOWED_EXTENSIONS))


def lenient_image_url(u: Column) -> Column:
    return F.coalesce(u.rlike(r"(?i)^(https?:)?//"), F.lit(False))


def looks_like_image(u: Column) -> Column:
    p, low = F.lower(U.path(u)), F.lower(u)
    return (
        U.scheme(u).isin("http", "https") & (p != "") & ~p.endswith(".svg") & ~contains_any(low, BLOCKED_URL_KEYWORDS)
        & (p.rlike(r"\.(jpg|jpeg|png|webp|bmp|tiff|tif|gif)\z") | contains_any(U.netloc(u), IMAGE_HOSTS))
    )


def meets_site_dimensions(site: Column, w: Column, h: Column) -> Column:
    by_area = (F.least(w, h) >= AREA_MIN_SIDE) & (w * h >= AREA_MIN)
    out = F.when(site.isin(AREA_SITES), by_area)
    for name, (a, b) in SITE_MIN_DIMENSIONS.items():
        out = out.when(site == name, (w >= a) & (h >= b))
    return out.otherwise((w >= DEFAULT_MIN_DIMENSIONS[0]) & (h >= DEFAULT_MIN_DIMENSIONS[1]))


def url_rules(df: DataFrame, rules: DataFrame, site: str, url: str) -> DataFrame:
    """Rows allowed by rules (site, allow array, deny array), a small table; sites without rules allow everything."""
    low = F.lower(F.col(url))
    with_rules = df.join(F.broadcast(rules), site, "left")
    allow = F.coalesce(F.size("allow"), F.lit(0)) <= 0
    ok = (allow | F.exists("allow", lambda a: low.contains(a))) & ~F.coalesce(F.exists("deny", lambda a: low.contains(a)), F.lit(False))
    return with_rules.filter(F.coalesce(ok, F.lit(True))).drop("allow", "deny")


def is_page_link(href: Column, page: Column) -> Column:
    """A link to a page of the same site."""
    u = U.resolve(page, href)
    non_html = U.path(u).rlike(r"(?i)\.(?:" + "|".join(e[1:] for e in NON_HTML) + r")\z")
    return (F.coalesce(href, F.lit("")) != "") & ~href.rlike(r"^(#|mailto:|tel:|javascript:)") & U.scheme(u).isin("http", "https") & U.same_site(U.netloc(u), U.netloc(page)) & ~non_html


def is_news(*fields: Column) -> Column:
    return contains_any(joined(*fields), ["news", "newspaper"])


def excluded_by_name(name: Column, words: list[str]) -> Column:
    return contains_any(F.lower(F.coalesce(name, F.lit(""))), [w.lower() for w in words])


def upscale_needed(w: Column, h: Column, target: int = 224, min_ratio: float = 0.5) -> Column:
    return X.upscale(w, h, target)["ratio"] > 1 / min_ratio


def not_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def first_reason(**rules: Column) -> Column:
    """Name of the first rule that holds, in the order given; null if none does."""
    return F.coalesce(*[F.when(hit, F.lit(name)) for name, hit in rules.items()])


def analyst_filters(n_bytes: Column, w: Column, h: Column, parent: Column, loading: Column) -> dict[str, Column]:
    """The usual selections of an image catalogue, by name."""
    return {"heavy": n_bytes > 500_000, "wide": w > 1920, "in_picture": F.lower(parent) == "picture", "lazy": F.lower(loading) == "lazy", "tiny": (w < 200) | (h < 200)}


def without_labels(df: DataFrame, label: str, excluded: list) -> DataFrame:
    """Rows whose label is not excluded; rows without a label stay."""
    return df.filter(~F.coalesce(F.col(label).isin(excluded), F.lit(False))) if excluded else df


def labelled(df: DataFrame, label: str, balanced: bool) -> DataFrame:
    """Rows that may be drawn: where classes are to be balanced those with a label only."""
    return df.filter(F.col(label).isNotNull()) if balanced else df
