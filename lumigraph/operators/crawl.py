"""Crawling as relational steps: links of pages, breadth-first reach, budgets per site."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigraph.functions import url as U
from lumigraph.functions.html import page_link_rows
from lumigraph.operators.filters import PRIORITY_PATHS, contains_any, is_page_link
from lumigraph.session import persist_shared


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, pos, link, is_priority) for links to pages of the same site, canonical, those to rich sections marked."""
    long = page_link_rows(pages, url, html).select(F.col("page_url").alias("url"), F.col("idx").alias("pos"), "href", F.col("url").alias("full"))
    long = long.filter(is_page_link(F.col("href"), F.col("url")))
    return long.select("url", "pos", U.canonical_page(F.col("full")).alias("link"), contains_any(F.lower(U.path(F.col("full"))), PRIORITY_PATHS).alias("is_priority"))


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(url, depth): pages by their least number of steps from the seeds, until nothing new is found or at a depth; one join a level over the level's new pages only."""
    seen = persist_shared(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    frontier = seen
    for depth in count(1):
        if max_depth is not None and depth > max_depth:
            break
        step = edges.join(frontier.select(F.col("url").alias("parent")), "parent").select(F.col("child").alias("url")).distinct()
        frontier = persist_shared(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionAll(frontier)
    return seen


def within_budget(df: DataFrame, site: str, order: list, most: int) -> DataFrame:
    """The first rows of each site in a given order; each task lets no more than so many rows of a site through to the ranking."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(site).orderBy(*order))).filter(F.col("__rn") <= most).drop("__rn")


def crawl(edges: DataFrame, seeds: DataFrame, images: DataFrame, max_depth: int, max_pages: int, max_images: int) -> tuple[DataFrame, DataFrame]:
    """(pages, images) of a crawl over known links: breadth first, by priority inside a level, so many pages a site and images a site.

    edges (parent, child), seeds (url), images (page_url, idx, url). The frontier of a site never holds more pages than
    max(250, 40 * max_pages); pages beyond it are not visited.
    """
    site = U.netloc(F.col("url"))
    found = reachable(edges, seeds, max_depth).withColumn("site", site).withColumn("priority", U.link_priority(F.col("url")))
    queued = within_budget(found, "site", [F.col("depth"), F.col("priority"), F.col("url")], max(250, 40 * max_pages))
    pages = persist_shared(within_budget(queued, "site", [F.col("depth"), F.col("priority"), F.col("url")], max_pages), "crawled")
    shown = images.join(pages.select(F.col("url").alias("page_url"), "site", "depth"), "page_url")
    first = shown.groupBy("site", "url").agg(F.min(F.struct("depth", "page_url", "idx")).alias("at"))
    return pages, within_budget(first, "site", [F.col("at"), F.col("url")], max_images).select("site", "url", "at.page_url", "at.depth")


def sitemap_pages(sitemaps: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(url) of the pages that sitemaps (url, xml) name, through sitemaps of sitemaps breadth first; images and other sites left out."""
    locs = F.transform(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), 1), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    named = sitemaps.select(F.col("url").alias("parent"), F.col("xml").rlike(r"(?i)<sitemapindex\b").alias("is_index"), F.explode(locs).alias("child"))
    reached = reachable(named.filter("is_index").select("parent", "child"), roots)
    if most is not None:
        reached = reached.orderBy("depth", "url").limit(most)
    pages = named.filter("not is_index").join(reached.select(F.col("url").alias("parent")), "parent", "left_semi")
    is_image = F.lower(U.path(F.col("child"))).rlike(r"\.(?:jpe?g|png|gif|webp|svg|bmp|tiff?|ico)$")
    return pages.filter(U.same_site(U.netloc(F.col("parent")), U.netloc(F.col("child"))) & ~is_image).select(F.col("child").alias("url")).distinct()


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(site, allow, prefix) of the rules that texts (site, text) of robots files have for an agent, else for all agents."""
    line = F.trim(F.regexp_replace(F.col("line"), r"#.*$", ""))
    lines = robots.select("site", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).select("site", "pos", F.lower(F.regexp_extract(line, r"^([A-Za-z-]+)\s*:", 1)).alias("field"), F.trim(F.regexp_extract(line, r"^[A-Za-z-]+\s*:(.*)$", 1)).alias("value")).filter("field in ('user-agent', 'allow', 'disallow')")
    # a group is one or more agents and the rules behind them; a file is small, so each is read by one fold
    fold = F.array_sort(F.collect_list(F.struct("pos", "field", "value")))
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("in_rules"), F.array().cast("array<struct<agents:array<string>,allow:boolean,prefix:string>>").alias("rules"))

    def step(acc: Column, x: Column) -> Column:
        name = F.array(F.lower(x["value"]))
        agents = F.when(x["field"] != "user-agent", acc["agents"]).when(acc["in_rules"], name).otherwise(F.concat(acc["agents"], name))
        rule = F.array(F.struct(acc["agents"].alias("agents"), (x["field"] == "allow").alias("allow"), x["value"].alias("prefix")))
        return F.struct(agents.alias("agents"), (x["field"] != "user-agent").alias("in_rules"), F.when((x["field"] == "user-agent") | (x["value"] == ""), acc["rules"]).otherwise(F.concat(acc["rules"], rule)).alias("rules"))

    rules = lines.groupBy("site").agg(F.aggregate(fold, start, step)["rules"].alias("rules"))
    own = F.filter("rules", lambda r: F.exists(r["agents"], lambda a: (a != "*") & F.lit(agent.lower()).contains(a)))
    every = F.filter("rules", lambda r: F.array_contains(r["agents"], "*"))
    return rules.select("site", F.explode(F.when(F.size(own) > 0, own).otherwise(every)).alias("r")).select("site", "r.allow", "r.prefix").distinct()


def allowed_by_robots(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose address the rules (site, allow, prefix) of its site don't forbid: the longest prefix decides, allow on ties."""
    target = F.concat(U.path(F.col(url)), F.when(U.query_string(F.col(url)) == "", "").otherwise(F.concat(F.lit("?"), U.query_string(F.col(url)))))
    listed = rules.groupBy("site").agg(F.collect_list(F.struct(F.length("prefix").alias("n"), "allow", "prefix")).alias("__rules"))  # the rules of one file
    quoted = lambda p: F.regexp_replace(F.regexp_replace(p, r"([\\.+?^(){}|\[\]])", r"\\$1"), r"\*", ".*")
    rows = urls.withColumn("__site", U.netloc(F.col(url))).withColumn("__target", target).join(listed.withColumnRenamed("site", "__site"), "__site", "left")
    hits = F.filter("__rules", lambda r: F.regexp_like(F.col("__target"), F.concat(F.lit("^"), quoted(r["prefix"]))))
    verdict = F.coalesce(F.array_max(hits)["allow"], F.lit(True))
    return rows.filter(verdict).drop("__site", "__target", "__rules")


def frontier_queue(pending: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """Pages not yet visited, each once, with their priority."""
    todo = pending.select(url).distinct().join(visited.select(url).distinct(), url, "left_anti")
    return todo.withColumn("priority", U.link_priority(F.col(url)))
