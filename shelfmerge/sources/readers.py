"""Reading worklists, site exports, captures, sitemaps and pages."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfmerge.functions.ids import normalize_isbn
from shelfmerge.functions.urls import canonical_url, classify_url
from shelfmerge.operators import worklist

CAPTURE = StructType(
    [
        StructField(c, StringType())
        for c in (
            "SITE", "URL", "URL PORTADA", "ISBN", "ISBN10", "TITULO", "AUTOR", "ENCUADERNACION", "FECHA PUBLICACION",
            "EDITORIAL", "IDIOMA", "PAGINAS", "DIMENSIONES", "SINOPSIS",
        )
    ]
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw) of text files; numbers rise within a file, and a leading BOM is dropped."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("raw"))
    return rows.withColumn("raw", F.regexp_replace("raw", "^﻿", ""))


def read_isbn_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return worklist.isbn_lines(read_lines(spark, path), limit)


def read_query_items(spark: SparkSession, path: str, mode: str = "pair") -> DataFrame:
    return worklist.parse_query_items(read_lines(spark, path), mode)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_site_csv(spark: SparkSession, path: str) -> DataFrame:
    """A site's export with header; its isbn column, however written, also as isbn. A missing file has no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "isbn string")
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    named = [c for c in df.columns if c.strip().lower().lstrip("﻿") == "isbn"]
    if not named:
        return df.withColumn("isbn", F.lit(None).cast("string"))
    return df.withColumnRenamed(named[0], "isbn").withColumn("isbn", normalize_isbn(F.col("isbn")))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captured items, one JSON object or an array of them per file, from a file, folder or glob; site and url needed."""
    schema = StructType(CAPTURE.fields + [StructField("_amazon_detail_kv", StringType())])
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    detail = F.from_json("_amazon_detail_kv", "map<string,string>")
    return df.withColumn("detail", detail).drop("_amazon_detail_kv").filter("trim(SITE) <> '' and trim(URL) <> ''")


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """A queue from CSV whose header names isbn, or from text with one number a line."""
    first = (spark.read.text(path).first() or [""])[0].lower()
    columns = ["isbn", "site", "url", "titulo", "amazon_search_url"]
    if "isbn" in first and "," in first:
        df = spark.read.option("header", True).csv(path)
        for c in columns:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(""))
        return worklist.queue_rows(df.select(*columns).withColumn("pos", F.monotonically_increasing_id()))
    df = read_lines(spark, path).select(F.col("line_no").alias("pos"), F.col("raw").alias("isbn"))
    return worklist.queue_rows(df.select("pos", "isbn", *[F.lit("").alias(c) for c in columns[1:]]), from_text=True)


def read_sitemap_urls(spark: SparkSession, path: str | list[str], row_tag: str = "url", products_only: bool = True) -> DataFrame:
    """Distinct addresses of a sitemap (row_tag url) or an index of sitemaps (row_tag sitemap), gzip or not."""
    df = spark.read.format("xml").option("rowTag", row_tag).schema("loc string").load(path)
    urls = df.select(canonical_url(F.col("loc")).alias("url")).filter("url <> ''").distinct()
    return urls.filter(classify_url(F.col("url")) == "product") if products_only else urls


#: Levels of indexes that are followed, and sitemaps that one index may name by the protocol.
INDEX_DEPTH = 3
INDEX_ENTRIES = 50_000


def read_sitemap_index(spark: SparkSession, path: str, folder: str | None = None, products_only: bool = True) -> DataFrame:
    """Distinct addresses of all sitemaps that an index names, and of those that these name, gzip or not.

    Sitemaps have been landed in folder (the index's own) under the last part of their
    address; those not there are left out. Names reach the driver, of which an index
    has a bounded number; the sitemaps themselves are read as one table.
    """
    folder = folder or path.rstrip("/").rpartition("/")[0]
    files, level = [path], [path]
    for _ in range(INDEX_DEPTH):
        named = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(level)
        last = F.regexp_extract(F.trim("loc"), r"([^/?#]+)(?:[?#].*)?$", 1).alias("name")
        names = [r.name for r in named.select(last).filter("name <> ''").distinct().limit(INDEX_ENTRIES * len(level)).collect()]
        level = [f for f in (f"{folder}/{n}" for n in sorted(names)) if f not in files and exists(spark, f)]
        if not level:
            break
        files += level
    return read_sitemap_urls(spark, files, "url", products_only)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


@F.udtf(returnType="kind string, link string")
class CategoryLinks:
    """Links of a category document, wherever they are nested: of its products, subcategories and pager."""

    KINDS = {"products": "product", "categories": "category", "subcategories": "category", "pagination": "pager", "pager": "pager"}

    def eval(self, text: str) -> Iterator[tuple[str, str]]:
        try:
            todo = deque([("other", json.loads(text or ""))])
        except ValueError:
            return
        while todo:
            kind, x = todo.popleft()
            if isinstance(x, list):
                todo.extend((kind, y) for y in x)
            elif isinstance(x, dict):
                for key, y in x.items():
                    if key in ("src", "href", "url") and isinstance(y, str):
                        yield kind, y
                    else:
                        todo.append((self.KINDS.get(key, kind), y))


def links_from_category_json(df: DataFrame) -> DataFrame:
    """(page_id, json) to (page_id, kind, link)."""
    spark = df.sparkSession
    spark.udtf.register("category_links", CategoryLinks)
    df.select("page_id", "json").createOrReplaceTempView("category_documents")
    return spark.sql("SELECT page_id, kind, link FROM category_documents, LATERAL category_links(json)")
