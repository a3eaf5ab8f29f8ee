"""Saved web search results to (title, url, content) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom import constants as K
from corpusloom.functions import text as X


def parse_serp(pages: DataFrame, max_results: int = 10, column: str = "html") -> DataFrame:
    """Result links of a saved result page with the snippet at the same position.
    Keeps all other columns and adds pos (from 0), title, url, content."""
    link = r'(?s)<a[^>]*class="result__a"[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    note = r'(?s)<td[^>]*class="result__snippet"[^>]*>(.*?)</td>'
    every = lambda pattern, group: F.regexp_extract_all(column, F.lit(pattern), F.lit(group))
    plain = lambda c: X.uni_trim(F.regexp_replace(c, r"<[^>]*>", ""))
    keep = [c for c in pages.columns if c != column]
    rows = pages.select(*keep, F.slice(every(link, 1), 1, max_results).alias("u"), every(link, 2).alias("t"), every(note, 1).alias("s"))
    return rows.select(*keep, "t", "s", F.posexplode("u").alias("pos", "url")).select(
        *keep, "pos", plain(F.get("t", F.col("pos"))).alias("title"), "url",
        F.substring(F.coalesce(plain(F.get("s", F.col("pos"))), F.lit("")), 1, K.WEB_CONTENT).alias("content"),
    )


_ITEM = "struct<title:string,name:string,url:string,link:string,content:string,snippet:string,text:string>"
_REPLY = f"struct<results:array<{_ITEM}>,data:array<{_ITEM}>,webPages:struct<value:array<{_ITEM}>>>"


def normalize_web_json(replies: DataFrame, column: str = "json", max_results: int | None = None) -> DataFrame:
    """Rows of provider replies. The shapes differ in where the list is and how its
    fields are called; an empty field falls back to the next name. A missing or broken
    reply gives no rows."""
    some = lambda *names: F.coalesce(*[F.when(F.length(f"r.{n}") > 0, F.col(f"r.{n}")) for n in names], F.lit(""))
    keep = [c for c in replies.columns if c != column]
    j = replies.select(*keep, F.from_json(column, _REPLY).alias("j"))
    items = F.coalesce("j.results", "j.data", "j.webPages.value")
    if max_results is not None:
        items = F.slice(items, 1, max_results)
    return j.select(*keep, F.posexplode(items).alias("pos", "r")).select(
        *keep, "pos", some("title", "name").alias("title"), some("url", "link").alias("url"),
        F.substring(some("content", "snippet", "text"), 1, K.WEB_CONTENT).alias("content"),
    )
