"""Line dedup by site-relative frequency.

For each host, the share of its pages that hold a line; lines above ``RATIO``,
long ones above ``LONG_RATIO``, are boilerplate of that site and are dropped from
its pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlake.llm.common import fresh
from spreadlake.llm.hosts import frequent, line_key, lines, with_common

RATIO, LONG_RATIO = 0.02, 0.004
#: A line on fewer pages is no repetition yet; from here on the share decides, at every size.
LEAST_PAGES = 3


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, counts: bool = True, long_ratio: float = LONG_RATIO) -> DataFrame:
    """``docs`` with the text of every row cleaned, and with ``counts`` also ``n_lines`` and ``n_dropped``.

    A line is boilerplate where more than ``ratio`` of the host's pages (of a
    line of ``hosts.LONG`` characters ``long_ratio``), and at least ``least``, hold it; white space at a line's ends does not count, and
    lines without a word are never dropped.  Every row is a page: repeated rows
    count each time.  A null host is a host; a null text has no lines and stays
    null; a page that loses all its lines keeps its row with an empty text.
    Columns are matched by name only here, so others may have any name; those
    called ``n_lines`` and ``n_dropped`` are replaced when counts are asked for.
    """
    text, host = F.col(f"`{text_col}`"), F.col(f"`{host_col}`")
    common = frequent(docs, host, F.transform(lines(text), line_key), ratio, long_ratio, least)
    mark, keep, all_of = fresh(docs, "common_lines"), fresh(docs, "kept_lines"), fresh(docs, "all_lines")
    base = docs.drop("n_lines", "n_dropped") if counts else docs
    joined = with_common(base, host, common, mark)
    dropped = lambda x: F.coalesce(F.array_contains(mark, line_key(x)), F.lit(False))
    done = joined.withColumn(all_of, lines(text)).withColumn(keep, F.when(F.col(mark).isNotNull(), F.filter(all_of, lambda x: ~dropped(x))).otherwise(F.col(all_of)))
    cleaned = F.when(F.size(keep) == F.size(all_of), text).otherwise(F.array_join(keep, "\n"))
    out = [cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in base.columns]
    if counts:
        size = lambda x: F.when(text.isNull(), F.lit(0)).otherwise(F.size(x)).cast("long")
        out += [size(all_of).alias("n_lines"), (size(all_of) - size(keep)).alias("n_dropped")]
    return done.select(*out)
