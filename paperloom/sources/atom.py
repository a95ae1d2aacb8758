"""Paper metadata from Atom feeds, as files or from a live endpoint."""

from __future__ import annotations

import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from paperloom.functions.text import clean_text, strip_version

ENDPOINT = "https://export.arxiv.org/api/query"
_SITE = "https://arxiv.org"

#: Entries as the XML source reads them; without a schema a single link would not be an array.
ENTRY = (
    "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, "
    "link array<struct<_href:string,_rel:string,_title:string>>, category array<struct<_term:string>>, "
    "`arxiv:primary_category` struct<_term:string>, `arxiv:comment` string, `arxiv:doi` string"
)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)


def parse_entries(entries: DataFrame) -> DataFrame:
    """Papers of Atom entries; error entries (by their id) are left out."""
    raw = F.coalesce("id", F.lit(""))
    paper = F.when(F.contains(raw, F.lit("/abs/")), F.element_at(F.split(raw, "/abs/"), -1)).otherwise(raw)
    secure = lambda c: F.replace(c, F.lit("http://"), F.lit("https://"))

    def last_link(wanted) -> Column:
        found = F.filter(F.coalesce("link", F.array().cast("array<struct<_href:string,_rel:string,_title:string>>")), lambda x: wanted(x) & (F.coalesce(x["_href"], F.lit("")) != ""))
        return secure(F.try_element_at(found, F.lit(-1))["_href"])

    is_pdf = lambda x: F.coalesce(x["_title"], F.lit("")) == "pdf"
    terms = F.filter(F.transform("category", lambda x: x["_term"]), lambda t: F.coalesce(t, F.lit("")) != "")
    names = F.filter(F.transform("author", lambda x: clean_text(x["name"])), lambda n: n != "")
    texts = F.array().cast("array<string>")
    day = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.substring(c, 1, 10))
    return entries.where(~F.contains(raw, F.lit("/api/errors"))).select(
        strip_version(paper).alias("paper_id"),
        F.when(F.col("title").isNull(), "Untitled").otherwise(clean_text(F.col("title"))).alias("title"),
        clean_text(F.col("summary")).alias("abstract"),
        F.coalesce(names, texts).alias("authors"),
        F.coalesce(day(F.col("published")), F.lit("Unknown")).alias("published_date"),
        day(F.col("updated")).alias("updated_date"),
        F.coalesce(last_link(is_pdf), F.concat(F.lit(f"{_SITE}/pdf/"), paper)).alias("pdf_url"),
        F.coalesce(last_link(lambda x: ~is_pdf(x) & (x["_rel"] == "alternate")), F.concat(F.lit(f"{_SITE}/abs/"), paper)).alias("abs_url"),
        F.coalesce(terms, texts).alias("categories"),
        F.coalesce(F.col("`arxiv:primary_category`._term"), F.try_element_at(terms, F.lit(1))).alias("primary_category"),
        F.when(F.col("`arxiv:comment`").isNotNull(), clean_text(F.col("`arxiv:comment`"))).alias("comment"),
        F.when(F.col("`arxiv:doi`").isNotNull(), clean_text(F.col("`arxiv:doi`"))).alias("doi"),
    )


def request_url(options: dict[str, str], endpoint: str = ENDPOINT) -> str:
    """The endpoint's address for id_list, or for search_query, start, max_results and sortBy."""
    if options.get("id_list"):
        params = {"id_list": options["id_list"]}
    else:
        params = {"search_query": options["search_query"], "start": options.get("start", "0"), "max_results": options.get("max_results", "5"), "sortBy": options.get("sortBy", "relevance"), "sortOrder": "descending"}
    return f"{endpoint}?{urllib.parse.urlencode(params)}"


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(request_url({**self.options, "search_query": q} if q else self.options, self.options.get("endpoint", ENDPOINT))) for q in self.options.get("search_query", "").split("\n")]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        with urllib.request.urlopen(partition.value, timeout=float(self.options.get("timeout", "30"))) as r:
            yield (r.read().decode("utf-8"),)


class AtomFeed(DataSource):
    """``spark.read.format("atom_feed")``: one row ``feed`` (the XML) for each search query (one a line)."""

    @classmethod
    def name(cls) -> str:
        return "atom_feed"

    def schema(self) -> str:
        return "feed string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FeedReader(dict(self.options))


def entries_of_feeds(feeds: DataFrame, feed: str = "feed") -> DataFrame:
    """Entries of feeds held as text."""
    parts = F.regexp_extract_all(F.col(feed), F.lit(r"(?s)<entry\b.*?</entry>"), F.lit(0))
    return feeds.select(F.explode(parts).alias("x")).select(F.from_xml("x", ENTRY, {"rowTag": "entry"}).alias("e")).select("e.*")
