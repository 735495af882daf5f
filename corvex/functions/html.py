"""HTML to text, links and table rows by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The entities that are replaced.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    """The common entities replaced, the ampersand last."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_tags(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags out, entities replaced, white space collapsed."""
    html = F.coalesce(html, F.lit(""))
    for pattern in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(F.regexp_replace(unescape(html), r"\s+", " "))


_LINK = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, position, href, label) of each link, and the id (first 10 hex digits of the SHA-1) of its address."""
    found = F.zip_with(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)), F.regexp_extract_all(html, F.lit(_LINK), F.lit(2)), lambda h, t: F.struct(h.alias("href"), t.alias("label")))
    rows = pages.select(key, F.posexplode(found).alias("position", "link"))
    return rows.select(key, "position", "link.href", strip_tags(F.col("link.label")).alias("label"), F.substring(F.sha1("link.href"), 1, 10).alias("url_id"))


def file_name(url: Column) -> Column:
    """The last part of an address's path, decoded."""
    return F.url_decode(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1))


def listing(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Links of a directory listing: parents, sort links and fragments left out."""
    rows = links(pages, key, html).where(~F.col("href").rlike(r"^(\?|#|\.\./|/$)"))
    return rows.withColumn("name", file_name(F.col("href")))
