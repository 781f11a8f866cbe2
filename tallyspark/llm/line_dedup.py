"""Removal of boilerplate lines by their frequency within a site, in DataFrame functions alone.

For each host, the pages that contain a line are divided by the host's pages; a line whose share exceeds the
ratio goes from all of that host's pages. Pages are counted by distinct text, so that a page copied many times
isn't boilerplate of its own, and a line must occur on LEAST distinct pages: one that stands on a single page is
no repetition, or a host's only page would lose all its lines. Callers may ask for more pages.

Lines are compared without spaces at their ends, and blank lines stay. Only 64-bit hashes of lines move; counts
are combined before the shuffle, and what joins back to the pages is a line list for each page that loses any.

Defined results: a null text stays null, an empty one empty; a null host is a host of its own; a page whose
lines all go has an empty text; rows stay as many as they were, repeated ones too, and other columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, table

RATIO = 0.1
LEAST = 2
#: Boilerplate lines that are broadcast at most, of 8 bytes each and their hosts' names.
SMALL = 200_000
SALTS = 64


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """host, line (hash): the lines that are to go. pages: page (a page's identity), host, text."""
    whole = pages.where("text is not null").select("host", F.xxhash64("text").alias("t"), "text")
    # a row for each page and distinct line; copies of a page within a host fall together before they are counted
    lines = whole.select("host", "t", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.when(F.length(F.trim(x)) > 0, _key(x))))).alias("line"))
    total = whole.select("host", "t").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    seen = lines.where("line is not null").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # hosts are salted by nothing: seen has one row for each frequent line, whatever the host's size
    joined = seen.join(total, seen["host"].eqNullSafe(total["host"])).select(seen["host"], "line", "n", "pages")
    return joined.where(F.col("n") > ratio * F.col("pages")).select("host", "line")


def drop_lines(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST
) -> DataFrame:
    """docs with the boilerplate lines of each host taken out of text_col; `__removed` counts them."""
    pages = docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    found = cut(boilerplate(pages, ratio, least))
    # a host's list is bounded by its pages' mean number of lines over the ratio
    lists = found.groupBy("host").agg(F.collect_set("line").alias("__lines"))
    host = F.col(host_col).cast("string")
    lists = lists.select(F.col("host").alias("__host"), "__lines")
    if found.count() <= SMALL:
        wide = docs.join(F.broadcast(lists), host.eqNullSafe(F.col("__host")), "left")
    else:  # a host may hold a third of all pages: its list goes to each of SALTS parts
        salt = F.pmod(F.xxhash64(text_col), F.lit(SALTS))
        lists = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        wide = docs.join(lists, host.eqNullSafe(F.col("__host")) & (salt == F.col("__salt")), "left")
    parts = F.split(text_col, "\n")
    gone = lambda x: F.coalesce(F.array_contains("__lines", _key(x)) & (F.length(F.trim(x)) > 0), F.lit(False))
    kept = F.filter(parts, lambda x: ~gone(x))
    text = F.when(F.col("__lines").isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("__lines").isNull() | F.col(text_col).isNull(), 0).otherwise(F.size(parts) - F.size(kept)).cast("long")
    names = [F.col(c) if c != text_col else text.alias(c) for c in docs.columns]
    return wide.select(*names, removed.alias("__removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", F.col("__removed").alias("n_removed"))


SQL = f"""
with p as (select doc_id, source, text, string_split(text, chr(10)) as ls from documents),
u as (select distinct source, text from documents where text is not null),
n as (select source, count(*) as pages from u group by source),
x as (select distinct source, text, trim(l, ' ') as line from (select source, text, unnest(string_split(text, chr(10))) as l from u)),
f as (select x.source, x.line from x join n on x.source is not distinct from n.source
      where length(x.line) > 0 group by x.source, x.line, n.pages having count(*) >= {LEAST} and count(*) > {RATIO} * n.pages),
b as (select source, list(line) as bad from f group by source),
k as (select p.doc_id, p.source, p.text, p.ls,
             case when b.bad is null or p.text is null then p.ls
                  else list_filter(p.ls, lambda l: length(trim(l, ' ')) = 0 or not list_contains(b.bad, trim(l, ' '))) end as kept
      from p left join b on p.source is not distinct from b.source)
select doc_id, source, case when text is null then null else array_to_string(kept, chr(10)) end as text,
       coalesce(len(ls) - len(kept), 0) as n_removed
from k
"""
