"""Readers of raw records: JSON, JSON lines, CSV, Parquet, nested groups, HTML pages; writers of their results."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.functions import text as T

#: Keys under which a JSON object keeps its records or its groups of records (fixed values).
RECORD_KEYS, GROUP_KEYS = ("records", "rows", "data", "items"), ("sequences", "series", "groups")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) is not None and len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)) > 0


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON, blank ones skipped; a missing file has no rows."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files, one document each: its top-level list, or the first list under one of RECORD_KEYS."""
    raw = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", f"array<struct<{_nested(schema)}>>")
    keyed = [F.from_json(F.get_json_object("value", f"$.{k}"), f"array<struct<{_nested(schema)}>>") for k in RECORD_KEYS]
    is_list = F.ltrim("value").startswith("[")
    return raw.select(F.explode(F.when(is_list, as_list).otherwise(F.coalesce(*keyed))).alias("r")).select("r.*")


def _nested(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in schema.split(",")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False)


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By the suffix; other files have no rows."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    if path.endswith(".json"):
        return read_json_records(spark, path, schema)
    if path.endswith(".csv"):
        names = [x.strip().split(" ", 1) for x in schema.split(",")]
        raw = read_csv(spark, path)
        return raw.select(*[(F.col(n) if n in raw.columns else F.lit(None)).try_cast(t).alias(n) for n, t in names])
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


#: Where a page says its date, and where its body stands, in order of precedence (fixed values): element, class, and the element or
#: classes that it lies in.
DATED = (("p", "article__time"), ("p", "article__meta"), ("time", ""), ("h5", ""), ("h3", ""))
BODY = (("p", "div.col-xs-12.col-sm-8.col-md-8"), ("li", "div.col-xs-12.col-sm-8.col-md-8"), ("p", "article"), ("p", "main"))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_GRID = frozenset({"col-xs-12", "col-sm-8", "col-md-8"})


class _Element:
    def __init__(self, tag: str, attrs: dict[str, str | None], inside: frozenset[str]):
        self.tag, self.href, self.classes = tag, attrs.get("href"), frozenset((attrs.get("class") or "").split())
        own = {tag} if tag in ("article", "main") else {BODY[0][1]} if tag == "div" and self.classes >= _GRID else set()
        self.inside, self.holds, self.parts = inside, inside | own, []

    def text(self) -> str:
        return " ".join(" ".join(self.parts).split())


class _Page(HTMLParser):
    """Elements of a page in the order in which they begin, and the text of the whole page. A paragraph or list item ends where the
    next one of its kind begins, if not before."""

    KEPT = frozenset({"p", "li", "h3", "h5", "time", "title", "a"})
    SKIPPED = frozenset({"script", "style"})

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.open, self.elements, self.texts = base, [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        if tag in ("p", "li"):
            self._close(tag, upto="li" if tag == "p" else "ul")
        found = _Element(tag, dict(attrs), self.open[-1].holds if self.open else frozenset())
        self.open.append(found)
        if tag in self.KEPT:
            self.elements.append(found)

    def _close(self, tag: str, upto: str = "") -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag == upto:
                return

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        if not any(e.tag in self.SKIPPED for e in self.open):
            self.texts.append(data)
            for e in self.open:
                e.parts.append(data)

    def dated(self) -> list[str]:
        return [e.text() for tag, cls in DATED for e in self.elements if e.tag == tag and (not cls or cls in e.classes)]

    def body(self) -> str:
        for tag, where in BODY:
            if text := "\n".join(t for e in self.elements if e.tag == tag and where in e.inside and (t := e.text())):
                return text
        return " ".join(" ".join(self.texts).split())

    def links(self) -> list[dict[str, str]]:
        return [{"href": urljoin(self.base, e.href), "text": e.text()} for e in self.elements if e.tag == "a" and e.href]


_PAGE = "url string, title string, dated string, body string, links array<struct<href: string, text: string>>"


def parse_pages(pages: DataFrame) -> DataFrame:
    """(url, title, dated, body, links) of (url, html): dated is what the elements of DATED say, in that order, body the lines of
    the first of BODY that has any, or else the whole page's text; links are absolute."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url, html in zip(batch["url"], batch["html"], strict=True):
                page = _Page(url or "")
                page.feed(html or "")
                page.close()
                title = next((e.text() for e in page.elements if e.tag == "title"), "")
                out.append((url, title, " | ".join(page.dated()), page.body(), page.links()))
            yield pd.DataFrame(out, columns=["url", "title", "dated", "body", "links"])

    return pages.select("url", "html").mapInPandas(run, _PAGE)


def calendar_pages(parsed: DataFrame, root: str, pattern: str) -> DataFrame:
    """(url): the root page and what it links to by the pattern, each once, the last by name first."""
    archives = links(parsed.where(F.col("url") == root)).where(F.col("href").rlike(pattern)).select(F.col("href").alias("url"))
    return parsed.where(F.col("url") == root).select("url").unionByName(archives).distinct().orderBy(F.desc("url"))


def links(parsed: DataFrame, *parts: str) -> DataFrame:
    """(url, href, text) of links whose address holds all of the parts."""
    rows = parsed.select("url", F.explode("links").alias("l")).select("url", "l.href", "l.text")
    for p in parts:
        rows = rows.where(F.col("href").contains(p))
    return rows


def articles(parsed: DataFrame, kind: Column) -> DataFrame:
    """Document records of parsed pages."""
    date = F.coalesce(T.long_date(F.col("dated")), T.date_from_url(F.col("url")))
    return parsed.select(date.alias("date"), T.meeting_type(F.col("title"), F.col("body")).alias("meeting_type"), T.document_title(F.col("title"), kind, F.col("url"), date).alias("title"), "url", kind.alias("document_type"), F.col("body").alias("text"))


def write(df: DataFrame, path: str, kind: str) -> None:
    """As a folder of parts: parquet, json or csv; a failure is an error."""
    getattr(df.write.mode("overwrite"), kind)(path, **({"header": True} if kind == "csv" else {}))
