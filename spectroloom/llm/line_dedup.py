"""Boilerplate lines by their frequency within a site; DataFrame functions only.

For each host, the pages that contain a line are divided by the host's pages; lines above a ratio go.
Copies of a page may count as one, so that its lines are left for a deduplication of whole pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectroloom.llm.common import checkpointed

#: A line goes if more than this part of its host's pages contain it ...
MAX_RATIO = 0.1
#: ... and at least so many pages do.
MIN_PAGES = 3
#: Boilerplate lines that are broadcast at most; more are joined by host and salt.
BROADCAST_LINES = 100_000
#: Parts that a host's pages are dealt over in the join.
SALTS = 64


def url_host(url: Column) -> Column:
    """The host of a URL, for tables that hold one."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _line_key(line: Column) -> Column:
    """128 bits of a line's content: a second hash that starts from another seed."""
    return F.concat_ws(":", F.xxhash64(line), F.xxhash64(F.lit(1), line))


def _hosted(docs: DataFrame, host: str | Column, text: str) -> DataFrame:
    own = F.coalesce((docs[host] if isinstance(host, str) else host).cast("string"), F.lit(""))
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), own.alias("host"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def boilerplate_lines(docs: DataFrame, host: str | Column = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """``(host, line_key, n_pages, n_host_pages)`` of the lines above the ratio, counted over all pages, or all distinct page texts.

    A null host counts as the empty one, a null text as a page without lines; blank lines are left out,
    and repeated rows are pages of their own unless ``copies_once``. An empty table gives no line.
    """
    page = ["t1", "t2"] if copies_once else []
    rows = _hosted(docs, host, text).select("host", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    lines = rows.select("host", *page, F.explode(F.array_distinct(_lines(F.col("text")))).alias("line")).where("trim(line) != ''")
    lines = lines.select("host", *page, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    if copies_once:
        rows, lines = rows.select("host", *page).distinct(), lines.distinct()
    pages = rows.groupBy("host").agg(F.count("*").alias("n_host_pages"))
    counts = lines.groupBy("host", "h1", "h2").agg(F.count("*").alias("n_pages"))
    counts = counts.where(F.col("n_pages") >= min_pages).select("host", F.concat_ws(":", "h1", "h2").alias("line_key"), "n_pages")
    return counts.join(pages, "host").where(F.col("n_pages") > max_ratio * F.col("n_host_pages"))


def _with_boilerplate(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` with the array ``found`` of their host's boilerplate keys that they hold."""
    lines = checkpointed(lines.select("host", "line_key"))
    by_host = lines.groupBy("host").agg(F.collect_list("line_key").alias("keys"))  # under lines per page / ratio of them
    if lines.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(by_host), "host", "left")
    else:
        salted = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("text", "row"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    own = F.transform(_lines(F.col("text")), _line_key)
    return joined.withColumn("found", F.when(F.col("keys").isNull(), F.array().cast("array<string>")).otherwise(F.array_intersect(own, F.col("keys"))))


def _kept_text() -> Column:
    kept = F.filter(_lines(F.col("text")), lambda line: ~F.array_contains(F.col("found"), _line_key(line)))
    return F.when(F.size("found") == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))


def drop_boilerplate(docs: DataFrame, host: str | Column = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """``docs`` with its columns, the text without boilerplate lines.

    Lines end at a line feed and are compared whole. Blank lines are never boilerplate. A page counts a
    line once, and repeated rows count as pages of their own; with ``copies_once``, pages of a host with
    equal texts (null as empty) count as one, so that many copies don't make their own lines boilerplate.
    A null host is a host of its own, shared with the empty one. Null texts stay null; a text whose lines all go becomes empty. Other columns,
    whatever their names, pass through.
    """
    rows = _with_boilerplate(_hosted(docs, host, text), boilerplate_lines(docs, host, text, max_ratio, min_pages, copies_once))
    kept = F.when(F.col("row").getField(text).isNotNull(), _kept_text())
    return rows.select(*[(kept if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, doc_id: str = "doc_id", host: str | Column = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per page: its lines, how many are boilerplate, and a digest of the text without them."""
    rows = _with_boilerplate(_hosted(docs.select(doc_id, host, text) if isinstance(host, str) else docs, host, text), boilerplate_lines(docs, host, text, max_ratio, min_pages))
    lines = _lines(F.col("text"))
    gone = F.when(F.size("found") == 0, 0).otherwise(F.size(F.filter(lines, lambda line: F.array_contains(F.col("found"), _line_key(line)))))
    return rows.select(F.col("row").getField(doc_id).alias("doc_id"), F.size(lines).cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"), F.sha2(_kept_text(), 256).alias("kept_sha256"))
