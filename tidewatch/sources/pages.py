"""Item lists inside landed HTML pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Login wall sentences, payload script and the start of an item object.
LOGIN_WALL = r"(?i)登录后(?:查看|阅读)|请先登录|login required"
PAYLOAD = r"(?s)<script[^>]*>\s*self\.__next_f\.push\((\[1,.*?\])\)\s*</script>"
ITEM_START = re.compile(r'\{"id":(?:\d+|"\d+"),"title":')
ITEM_SCHEMA = (
    "id string, title string, abstract string, source string, url string, created_at string, updated_at string, "
    "category struct<id: long, name: string>, content_categories array<string>"
)


def _objects(text: str) -> list[str]:
    """Complete JSON objects that begin like an item."""
    decoder, found = json.JSONDecoder(), []
    for match in ITEM_START.finditer(text):
        try:
            _, end = decoder.raw_decode(text, match.start())
        except ValueError:
            continue
        found.append(text[match.start() : end])
    return found


def _payload(expression: str) -> str:
    try:
        value = json.loads(expression)
    except ValueError:
        return ""
    return value[1] if isinstance(value, list) and len(value) > 1 and isinstance(value[1], str) else ""


def extract_page_items(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """Item rows of every page; a walled or empty page is one row with ``page_error``.

    Spark finds the payload scripts; only cutting complete objects out of the joined payload
    is Python, on Arrow batches.  The last object of an id wins within a page;
    a page id that comes twice keeps the error row of its empty copy.
    """
    scripts = pages.select(
        page,
        F.col(html).rlike(LOGIN_WALL).alias("walled"),
        F.regexp_extract_all(html, F.lit(PAYLOAD), F.lit(1)).alias("payloads"),
    )
    page_type = pages.schema[page].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            objects = [
                _objects("\n".join(_payload(p) for p in payloads)) if not walled else []
                for walled, payloads in zip(batch["walled"], batch["payloads"], strict=True)
            ]
            yield pd.DataFrame({page: batch[page], "walled": batch["walled"], "objects": objects})

    cut_rows = scripts.mapInPandas(cut, f"{page} {page_type}, walled boolean, objects array<string>")
    parsed = F.transform("objects", lambda text: F.from_json(text, ITEM_SCHEMA))
    valid = F.filter(
        parsed, lambda item: item["title"].isNotNull() & (F.length(item["title"]) > 0) & item["created_at"].isNotNull()
    )
    # a page without valid items is one row without an item, so one pass and one grouping give items and errors
    listed = cut_rows.select(page, "walled", F.posexplode_outer(valid).alias("position", "item"))
    last = listed.groupBy(page, F.col("item.id").alias("item_id")).agg(
        F.max_by("item", "position").alias("item"), F.bool_or("walled").alias("walled")
    )
    error = F.when(F.col("walled"), "LOGIN_WALL").otherwise("SCHEMA_DRIFT_OR_EMPTY_LIST")
    found = last.select(page, "item_id", "walled", F.col("item").isNull().alias("empty"), *raw_item_columns("item"))
    names = [c for c in found.columns if c not in (page, "item_id", "walled", "empty")]
    return found.select(
        page, "item_id", *[F.when(~F.col("empty"), F.col(c)).alias(c) for c in names],
        F.when(F.col("empty"), error).alias("page_error"),
    )


def raw_item_columns(item: str) -> list:
    """Defaults of a raw item: missing abstract is empty, a null category is allowed."""
    i = F.col(item)
    return [
        i["title"].alias("title"),
        F.coalesce(i["abstract"], F.lit("")).alias("abstract"),
        F.coalesce(i["source"], F.lit("")).alias("source"),
        F.coalesce(i["url"], F.lit("")).alias("url"),
        F.unix_millis(i["created_at"].try_cast("timestamp")).alias("created_ms"),
        F.unix_millis(i["updated_at"].try_cast("timestamp")).alias("updated_ms"),
        i["category"]["name"].alias("category"),
        F.coalesce(i["content_categories"], F.array().cast("array<string>")).alias("content_categories"),
    ]


def read_news_raw(lines: DataFrame, text: str = "value") -> DataFrame:
    """Raw item JSON lines with defaults; rows that are not items get ``item_error``."""
    parsed = lines.withColumn("__item", F.from_json(text, ITEM_SCHEMA))
    ok = (
        F.col("__item.id").rlike("^[0-9]+$")
        & (F.length("__item.title") > 0)
        & F.col("__item.created_at").try_cast("timestamp").isNotNull()
    )
    return parsed.select(
        F.col("__item.id").alias("item_id"),
        *raw_item_columns("__item"),
        F.when(~F.coalesce(ok, F.lit(False)), "INVALID_ITEM").alias("item_error"),
    )


def url_item_id(url: str = "url"):
    """Item id at the end of a page path (query, fragment and host removed), else null."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+(/[^?#]*)", 1)
    return F.nullif(F.regexp_extract(path, r"/([0-9]+)$", 1), F.lit(""))


def page_item_detail(pages: DataFrame, items: DataFrame, page: str = "page_id", url: str = "url") -> DataFrame:
    """The item whose id the page URL names; a missing one is an error row."""
    wanted = pages.select(page, url, url_item_id(url).alias("item_id"))
    joined = wanted.join(items.drop("page_error"), [page, "item_id"], "left")
    return joined.withColumn(
        "detail_error",
        F.when(F.col("item_id").isNull(), "DETAIL_URL_INVALID").when(F.col("title").isNull(), "DETAIL_ITEM_MISSING"),
    )
