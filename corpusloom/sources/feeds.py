"""Feeds, search results and archives as text, parsed without a driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ITEM = r"(?is)<(?:item|entry)[^>]*>(.*?)</(?:item|entry)>"


def tag(item: Column, name: str) -> Column:
    """The trimmed content of an element, its CDATA first, of which adjoining sections are one; null if empty or absent."""
    inner = [F.regexp_extract(item, p, 1) for p in (rf"(?is)<{name}[^>]*><!\[CDATA\[(.*?)\]\]></{name}>", rf"(?is)<{name}[^>]*>(.*?)</{name}>")]
    inner[0] = F.replace(inner[0], F.lit("]]><![CDATA["), F.lit(""))
    return F.coalesce(*[F.nullif(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit("")) for x in inner])


def attribute(item: Column, name: str, key: str) -> Column:
    return F.nullif(F.regexp_extract(item, rf"""(?is)<{name}[^>]*\s{key}=["']([^"']+)["']""", 1), F.lit(""))


def items(feeds: DataFrame) -> DataFrame:
    """One row for each usable item of feeds(config_name, xml).

    The id is the guid, else the link. The body is the full content, else the description; a body under 20 characters
    gives way to the title. Items without id or with less than 20 characters go. Dates that cannot be read are null.
    """
    x = feeds.select("config_name", F.explode(F.regexp_extract_all("xml", F.lit(ITEM), F.lit(1))).alias("i"))
    i = F.col("i")
    # In steps, so that nothing that is used more than once is worked out more than once.
    x = x.select(
        F.col("config_name").alias("source"),
        F.coalesce(tag(i, "link"), attribute(i, "link", "href")).alias("source_url"),
        tag(i, "guid").alias("guid"),
        tag(i, "title").alias("title"),
        F.coalesce(tag(i, "content:encoded"), tag(i, "description"), F.lit("")).alias("body"),
        F.coalesce(attribute(i, "enclosure", "url"), attribute(i, "media:content", "url"), attribute(i, "media:thumbnail", "url")).alias("image_url"),
        F.coalesce(tag(i, "pubDate"), tag(i, "dc:date"), tag(i, "updated")).alias("raw_date"),
    )
    body, title = T.strip_markup(F.col("body")), F.col("title")
    x = x.withColumn("body", body).withColumn("text", F.when((F.length("body") < 20) & title.isNotNull(), title).otherwise(F.col("body")))
    x = x.select("source", F.coalesce("guid", "source_url").alias("source_id"), "title", "source_url", "image_url", "text", F.create_map(F.lit("raw_pub_date"), F.col("raw_date")).alias("metadata"), T.parsed_date(F.col("raw_date")).alias("published_at"))
    return x.where(F.col("source_id").isNotNull() & (F.length("text") >= 20))


def search_feed(feeds: DataFrame) -> DataFrame:
    """Items of feeds(config_name, entity_id, xml) that have title and link, with the entity they were searched for."""
    x = feeds.select("config_name", "entity_id", F.explode(F.regexp_extract_all("xml", F.lit(ITEM), F.lit(1))).alias("i"))
    x = x.select("config_name", "entity_id", T.strip_markup(tag(F.col("i"), "title")).alias("title"), tag(F.col("i"), "link").alias("source_url"), T.strip_markup(F.coalesce(tag(F.col("i"), "description"), F.lit(""))).alias("text"), T.parsed_date(tag(F.col("i"), "pubDate")).alias("published_at"))
    return x.where(F.col("title").isNotNull() & F.col("source_url").isNotNull()).withColumn("metadata", F.create_map(F.lit("configured_entity_id"), F.col("entity_id").cast("string")))


def search_results(pages: DataFrame, most: int = 15) -> DataFrame:
    """entity_id, title, source_url, source_id of the first results of result pages(entity_id, html); redirect links are unwrapped."""
    x = pages.select("entity_id", F.posexplode(F.slice(F.regexp_extract_all("html", F.lit(r"""(?is)(<a[^>]+class=["'][^"']*result__a[^"']*["'][^>]*>.*?</a>)"""), F.lit(1)), 1, most)).alias("rank", "a"))
    href = F.regexp_replace(F.regexp_extract("a", r"""(?i)href=["']([^"']+)["']""", 1), "&amp;", "&")
    href = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    url = F.coalesce(T.query_value(href, "uddg"), href)
    return x.select("entity_id", "rank", T.strip_markup(F.col("a")).alias("title"), url.alias("source_url"), F.left(F.sha2(url, 256), F.lit(32)).alias("source_id"))


def archive_request(base: str, query: str, first: str, last: str, n: int = 100) -> str:
    """The address of an archive's answer: so many articles of some days, the newest first."""
    from urllib.parse import urlencode

    stamp = lambda day, time: day.replace("-", "") + time
    return f"{base}?" + urlencode({"query": query, "mode": "artlist", "format": "json", "sort": "datedesc", "maxrecords": n, "startdatetime": stamp(first, "000000"), "enddatetime": stamp(last, "235959")})


def excluded(url: Column, domain: Column, domains: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> Column:
    """Whether an address belongs to a domain that is left out, or a part of it, or begins in a way that is."""
    host = F.lower(F.coalesce(domain, T.url_host(url), F.lit("")))
    out = F.lit(False)
    for d in domains:
        out |= (host == d) | F.endswith(host, F.lit(f".{d}"))
    for p in prefixes:
        out |= F.startswith(F.coalesce(url, F.lit("")), F.lit(p))
    return out


def archive(records: DataFrame) -> DataFrame:
    """Articles of archive answers(json): title, url, domain, date; the newest first in each answer."""
    schema = "articles array<struct<url:string,title:string,domain:string,seendate:string,language:string>>"
    x = records.select(F.explode(F.from_json("json", schema)["articles"]).alias("a"))
    return x.select("a.title", F.col("a.url").alias("source_url"), "a.domain", "a.language", F.left(F.sha2("a.url", 256), F.lit(32)).alias("source_id"), T.parsed_date(F.col("a.seendate")).alias("published_at"))


def targets(hot: DataFrame, people: DataFrame) -> DataFrame:
    """Names to search for: the first list, then the second; of equal ids the first stays."""
    from ..operators import dedup

    both = hot.withColumn("_l", F.lit(0)).unionByName(people.withColumn("_l", F.lit(1)))
    return dedup.pairs(both, ["entity_id"], ["_l"]).drop("_l")
