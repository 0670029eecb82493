"""Records of landed API responses ``(url, page_no, body)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluice.functions.scalars import json_object, query_path
from sluice.functions.values import variant_path
from sluice.session import stored


def unnest(pages: DataFrame, data_field: str | None = None, paginated: bool = False, body: str = "body",
           keep: list[str] = ()) -> DataFrame:
    """One VARIANT ``rec`` per record of a response.

    Unpaginated: the items of an array ``data``, else the whole object.  Paginated: with
    ``data_field`` the items of that array, without it the whole body.  Items that are not
    objects are left out.
    """
    parsed = pages.select(*keep, json_object(F.col(body)).alias("_body")).filter(F.col("_body").isNotNull())
    if paginated and not data_field:
        return parsed.select(*keep, F.col("_body").alias("rec"))
    items = F.try_variant_get("_body", variant_path(data_field or "data"), "array<variant>")
    found = items if paginated else F.coalesce(items, F.array("_body"))
    return (
        parsed.select(*keep, F.explode(found).alias("rec"))
        .filter(F.try_variant_get("rec", "$", "map<string,variant>").isNotNull())
    )


def follow_next(pages: DataFrame, starts: DataFrame, next_field: str = "next", max_pages: int | None = None) -> DataFrame:
    """Pages reached from each start url: ``start``, ``url``, ``page_no`` (1-based).

    A chain ends where ``next_field`` is missing or empty, where its page was not landed, at a page it has
    met before, or at ``max_pages`` where that is given (then a circle is followed round and round).  The known stretch of all
    chains doubles with each round, so the number of joins grows with the logarithm of the longest chain.
    """
    following = F.try_variant_get(F.try_parse_json("body"), f"$['{next_field}']", "string")
    link = pages.select("url", F.when(following != "", following).alias("to"))
    landed = pages.select(F.col("url").alias("to"))
    hop = link.join(landed, "to", "left_semi").select("url", "to")
    known = starts.join(pages.select("url"), "url", "left_semi").select(
        F.col("url").alias("start"), "url", F.lit(1).alias("page_no"))
    reach, size = 1, known.count() if max_pages is None else 0
    while max_pages is None or reach < max_pages:
        ahead = known.join(hop, "url").select("start", F.col("to").alias("url"),
                                              (F.col("page_no") + reach).alias("page_no"))
        both = known.unionByName(ahead)
        if max_pages is None:
            known = stored(both.groupBy("start", "url").agg(F.min("page_no").alias("page_no")))
            before, size = size, known.count()
            if size == before:
                break
        else:
            known = stored(both.filter(F.col("page_no") <= max_pages))
        if max_pages is None or 2 * reach < max_pages:
            second = hop.select(F.col("url").alias("to"), F.col("to").alias("far"))
            hop = stored(hop.join(second, "to").select("url", F.col("far").alias("to")))
        reach *= 2
    return known


def stop_pages(pages: DataFrame, kind: str, chain: str = "chain", data_path: str = ".data",
               offset_path: str = ".next_offset", count_path: str = ".count", per_page_path: str = ".per_page",
               max_pages: int | None = None) -> DataFrame:
    """Pages up to the first that stops the chain.

    ``page_increment`` stops at an empty page (which yields nothing), ``next_offset`` after a page
    without an offset, ``page_with_count`` after a page with fewer items than a full one.
    """
    body = F.try_parse_json("body")
    if kind == "page_increment":
        items = F.try_variant_get(query_path(body, data_path), "$", "array<variant>")
        stop, keep_last = F.coalesce(F.size(items), F.lit(0)) <= 0, False
    elif kind == "next_offset":
        offset = query_path(body, offset_path)
        stop, keep_last = offset.isNull() | F.is_variant_null(offset), True
    elif kind == "page_with_count":
        count, full = (F.try_variant_get(query_path(body, p), "$", "double") for p in (count_path, per_page_path))
        stop, keep_last = F.coalesce(count < full, F.lit(True)), True
    else:
        raise ValueError(f"unknown pagination {kind!r}")
    ends = pages.filter(stop).groupBy(chain).agg(F.min("page_no").alias("_end"))
    bounded = pages.join(ends, chain, "left")
    inside = F.col("page_no") <= F.col("_end") if keep_last else F.col("page_no") < F.col("_end")
    out = bounded.filter(F.col("_end").isNull() | inside).drop("_end")
    return out.filter(F.col("page_no") <= max_pages) if max_pages else out
