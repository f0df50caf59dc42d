"""Readers of pages and feeds that are already held as files or tables.

Nothing is fetched here.  Each reader takes whole files or a table of texts and
gives typed rows; what can't be parsed gives none.
"""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvina.functions import text as T
from corvina.functions.fixed import FIRST_YEAR, LAST_YEAR, LEAST_BODY
from corvina.session import stash

#: Types of JSON-LD objects that are articles.
ARTICLE_TYPES = ["NewsArticle", "ReportageNewsArticle", "Article", "BlogPosting"]
#: Types of captures that hold a page.
PAGE_TYPES = ["text/html", "text/plain", "warc/revisit"]


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row per file; gzip is opened by the reader."""
    return spark.read.text(path, wholetext=True)


@F.pandas_udf(StringType())
def _opened(contents: pd.Series) -> pd.Series:
    def read(raw: bytes) -> str | None:
        try:
            return (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8", "replace")
        except (OSError, EOFError, zlib.error):
            return None

    return contents.map(read, na_action="ignore")


def opened_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one row per file, opened where its first bytes say gzip, whatever it is called; broken ones are null."""
    return spark.read.format("binaryFile").load(path).select("path", _opened("content").alias("value"))


def source_kind(text: Column) -> Column:
    """What a text read from an address is: rss (Atom too), sitemap, html, or null."""
    head = F.lower(F.substring(text, 1, 2000))
    feed, site = head.rlike(r"<(?:\w+:)?(?:rss|feed|rdf)[\s>]"), head.rlike(r"<(?:\w+:)?(?:urlset|sitemapindex)[\s>]")
    return F.when(feed, "rss").when(site, "sitemap").when(head.rlike(r"<(?:!doctype html|html|head|body|a|div)[\s>]"), "html")


def cdx_pages(pages: DataFrame, text: str = "value") -> DataFrame:
    """(url, timestamp_cdx): captures of index pages, JSON arrays whose first row names the columns.

    A trailing resume key (a row of one string, after an empty row) is no
    capture; other media types and repeated addresses are left out.
    """
    rows = pages.select(F.from_json(text, "array<array<string>>").alias("rows")).where(F.size("rows") > 1)
    cells = rows.select(F.col("rows")[0].alias("head"), F.posexplode("rows").alias("at", "row")).where("at > 0").where(F.size("row") == F.size("head"))
    of = lambda name: F.get("row", F.array_position("head", name).cast("int") - 1)
    found = cells.select(of("original").alias("url"), of("timestamp").alias("timestamp_cdx"), of("mimetype").alias("mime")).where(F.col("mime").isin(PAGE_TYPES))
    return found.groupBy("url").agg(F.min("timestamp_cdx").alias("timestamp_cdx"))


def _tags(text: Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?is)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>"), F.lit(1))


def _first(text: Column, *names: str) -> Column:
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<!\[CDATA\[|\]\]>", ""), "&amp;", "&"))
    return F.coalesce(*[F.nullif(bare(F.get(_tags(text, n), F.lit(0))), F.lit("")) for n in names])


def sitemap_urls(files: DataFrame, text: str = "value") -> DataFrame:
    """(url, data_prevista): addresses of sitemaps with their last change, whatever the namespace."""
    return files.select(F.explode(_tags(F.col(text), "url")).alias("u")).select(_first(F.col("u"), "loc").alias("url"), F.substring(_first(F.col("u"), "lastmod", "publication_date"), 1, 10).alias("data_prevista")).where(F.col("url").startswith("http"))


def sitemap_children(files: DataFrame, text: str = "value") -> DataFrame:
    """(loc): the sitemaps that index files name."""
    return files.select(F.explode(_tags(F.col(text), "sitemap")).alias("s")).select(_first(F.col("s"), "loc").alias("loc")).where(F.col("loc").isNotNull())


def sitemap_tree(files: DataFrame, roots: DataFrame, loc: str = "loc", text: str = "value", depth: int = 3, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """(loc, level, url, data_prevista): addresses of all sitemaps that ``roots`` (loc) name, down to ``depth`` levels of index files.

    ``files`` (loc, value) are the sitemaps at hand.  None is read twice; a
    child whose address names only years outside the period is not followed.
    """
    held = files.select(F.col(loc).alias("loc"), F.col(text).alias("value"))
    named = F.transform(F.regexp_extract_all("loc", F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))
    level = roots.select(F.col(loc).alias("loc")).distinct().withColumn("level", F.lit(0))
    seen = level
    for k in range(1, depth + 1):
        read = held.join(level.select("loc"), "loc", "left_semi")
        found = sitemap_children(read).distinct().where((F.size(named) == 0) | F.exists(named, lambda y: y.between(first, last)))
        level = stash(found.join(seen, "loc", "left_anti").withColumn("level", F.lit(k)))
        if level.isEmpty():
            break
        seen = stash(seen.unionByName(level))
    urls = held.join(seen, "loc").select("loc", "level", F.explode(_tags(F.col("value"), "url")).alias("u"))
    return urls.select("loc", "level", _first(F.col("u"), "loc").alias("url"), F.substring(_first(F.col("u"), "lastmod", "publication_date"), 1, 10).alias("data_prevista")).where(F.col("url").startswith("http"))


def historical_sitemaps(snapshots: DataFrame, year: str = "ano", taken: str = "tirado_em", text: str = "value") -> DataFrame:
    """(url, data_prevista, ano, fonte_coleta): addresses of the first snapshot of each year, marked as historical."""
    first = snapshots.groupBy(F.col(year).alias("ano")).agg(F.min_by(text, taken).alias("value"))
    urls = first.select("ano", F.explode(_tags(F.col("value"), "url")).alias("u"))
    return urls.select(_first(F.col("u"), "loc").alias("url"), F.substring(_first(F.col("u"), "lastmod", "publication_date"), 1, 10).alias("data_prevista"), "ano", F.lit("sitemap_historico").alias("fonte_coleta")).where(F.col("url").startswith("http"))


def feed_items(files: DataFrame, text: str = "value") -> DataFrame:
    """(url, data_prevista): items of RSS and entries of Atom; the address is the link's text, its href, or a guid that is one."""
    item = files.select(F.explode(F.concat(_tags(F.col(text), "item"), _tags(F.col(text), "entry"))).alias("i"))
    href = F.nullif(F.regexp_extract("i", r"""(?is)<link\s[^>]*href=["']([^"']+)["']""", 1), F.lit(""))
    guid = F.when(_first(F.col("i"), "guid").startswith("http"), _first(F.col("i"), "guid"))
    return item.select(F.coalesce(_first(F.col("i"), "link"), href, guid).alias("url"), F.substring(_first(F.col("i"), "pubDate", "published", "updated", "date"), 1, 10).alias("data_prevista")).where(F.col("url").isNotNull())


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, link, anchor): links of pages to their own host, relative ones made whole."""
    a = pages.select(F.col(url).alias("url"), F.explode(F.regexp_extract_all(html, F.lit(r"""(?is)(<a\s[^>]*href=["'][^"']+["'][^>]*>.*?</a>)"""), F.lit(1))).alias("a"))
    root = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    href = F.regexp_extract("a", r"""(?is)href=["']([^"'#]+)""", 1)
    link = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(href)
    anchor = F.trim(F.regexp_replace(F.regexp_replace("a", r"<[^>]+>", " "), r"\s+", " "))
    return a.select("url", link.alias("link"), anchor.alias("anchor"), root.alias("root")).where(F.regexp_extract("link", r"^(https?://[^/]+)", 1) == F.col("root")).select("url", "link", "anchor").distinct()


def json_ld_articles(pages: DataFrame, url: str = "url", html: str = "html", least: int = 150) -> DataFrame:
    """(url, titulo, corpo, publicado, autor): the first article among the JSON-LD objects of each page.

    Objects may stand alone, in a list or under ``@graph``; an author may be a
    text, an object or a list; a body needs more than ``least`` characters.
    """
    script = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    one = pages.select(F.col(url).alias("url"), F.posexplode(script).alias("n", "json")).withColumn("json", F.trim("json"))
    listed = F.when(F.col("json").startswith("["), F.from_json("json", "array<string>")).otherwise(F.coalesce(F.from_json(F.get_json_object("json", "$.@graph"), "array<string>"), F.array("json")))
    o = one.select("url", "n", F.posexplode(listed).alias("m", "o"))
    get = lambda path: F.get_json_object("o", path)
    fields = o.select(
        "url", "n", "m", get("$.@type").alias("type"), F.coalesce(get("$.headline"), get("$.name")).alias("titulo"), F.coalesce(get("$.articleBody"), get("$.description")).alias("corpo"),
        F.coalesce(get("$.datePublished"), get("$.dateCreated")).alias("publicado"), F.coalesce(get("$.author.name"), get("$.author[0].name"), get("$.author[0]"), get("$.author")).alias("autor"),
    )
    good = fields.where(F.col("type").rlike("\\b(?:" + "|".join(ARTICLE_TYPES) + ")\\b") & (F.length("corpo") > least))
    return good.groupBy("url").agg(F.min_by(F.struct("titulo", "corpo", "publicado", "autor"), F.struct("n", "m")).alias("a")).select("url", "a.*")


def paragraphs(pages: DataFrame, url: str = "url", html: str = "html", least: int = 40) -> DataFrame:
    """(url, titulo, corpo): heading and paragraphs of pages, without scripts and the frames of the page."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1>", " ")
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), "&nbsp;|&amp;nbsp;", " "), r"\s+", " "))
    ps = F.filter(F.transform(_tags(bare, "p"), clean), lambda p: F.length(p) > least)
    title = F.coalesce(F.nullif(clean(F.get(_tags(F.col(html), "h1"), F.lit(0))), F.lit("")), F.nullif(clean(F.get(_tags(F.col(html), "title"), F.lit(0))), F.lit("")), F.lit("Sem Titulo"))
    return pages.select(F.col(url).alias("url"), title.alias("titulo"), F.array_join(ps, "\n\n").alias("corpo"))


def section_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, link, anchor, eixo): links of section pages that look like articles, with their axis by address and anchor."""
    links = page_links(pages, url, html).where(T.url_ok(F.col("link"), F.lit(None).cast("string")))
    return links.withColumn("eixo", T.topic_axis(F.col("link"), F.col("anchor")))


def extracted(pages: DataFrame, url: str = "url", html: str = "html", least: int = LEAST_BODY) -> DataFrame:
    """(url, titulo, corpo, publicado, autor, origem): the first reading of each page that is long enough; pages without one are left out.

    JSON-LD comes before paragraphs.
    """
    ld = json_ld_articles(pages, url, html, least - 1).select("url", F.struct("titulo", "corpo", "publicado", "autor", F.lit("json_ld").alias("origem")).alias("a"))
    none = F.lit(None).cast("string")
    ps = paragraphs(pages, url, html).where(F.length("corpo") >= least).select("url", F.struct("titulo", "corpo", none.alias("publicado"), none.alias("autor"), F.lit("paragrafos").alias("origem")).alias("b"))
    return ld.join(ps, "url", "full").select("url", F.coalesce("a", "b").alias("r")).select("url", "r.*")
