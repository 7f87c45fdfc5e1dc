"""Captures judged by the list entries that were active when they were fetched.

Dated entries (added, removed) become validity intervals. A capture looks up its own host, its
first path segment and every parent domain; the as-of condition is joined as an equality on the
pattern and a span of days, so a host that holds a third of all captures is dealt over its
spans, and what remains uneven is an ordinary sort-merge join that may be split at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.llm._shared import ascii_lower, text_or_empty

#: Longer hosts can't be in the domain name system; such captures have no host and match nothing.
LONGEST_HOST = 253
#: Days in a span of the join key.
SPAN = 91


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL without user and port; '' where there is none."""
    host = F.regexp_extract(ascii_lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(F.length(host) <= LONGEST_HOST, host).otherwise("")


def segment_of(url: Column) -> Column:
    """The first path segment, case kept; '' where there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Entries (list, pattern, day int, action 'add' or 'remove', seq) as (list, pattern, since, until).

    ``until`` is the day of the list's next event for the pattern, null while none came. Of several
    events on one day that with the greatest seq holds (then 'remove' before 'add'). Entries with a
    null list, pattern, day or action have no effect. An add while active only continues the entry.
    """
    whole = entries.where("list IS NOT NULL AND pattern IS NOT NULL AND day IS NOT NULL AND action IS NOT NULL")
    last = whole.groupBy("list", "pattern", "day").agg(F.max_by("action", F.struct("seq", "action")).alias("action"))
    # spans of days are dealt apart, a row a day at most in each; the first day of the next span is carried over
    last = last.withColumn("_span", F.floor(F.col("day") / SPAN))
    firsts = last.groupBy("list", "pattern", "_span").agg(F.min("day").alias("_first"))
    firsts = firsts.withColumn("_next", F.lead("_first").over(Window.partitionBy("list", "pattern").orderBy("_span")))
    firsts = firsts.where("_next IS NOT NULL").select(F.col("list").alias("_l"), F.col("pattern").alias("_p"), F.col("_span").alias("_s"), "_next")
    within = last.withColumn("_until", F.lead("day").over(Window.partitionBy("list", "pattern", "_span").orderBy("day")))
    met = within.join(firsts, (F.col("list") == F.col("_l")) & (F.col("pattern") == F.col("_p")) & (F.col("_span") == F.col("_s")), "left")
    return met.where("action = 'add'").select("list", "pattern", F.col("day").alias("since"), F.coalesce("_until", "_next").alias("until"))


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """(id_col, host, n_active, blocked, lists) for every row of ``captures``.

    Patterns are 'host:H', 'domain:D' (D and all its subdomains) and 'prefix:H/segment'. n_active
    counts the entries active on the capture's day, ``lists`` names their lists in order, joined by
    commas. A null or unparsable URL, or a null day, matches nothing and is not blocked. Repeated
    captures are each judged; an empty list blocks nothing.
    """
    url = text_or_empty(url_col)
    labels = F.split("_host", r"\.")
    keyed = captures.select(F.col(id_col).alias("_id"), F.col(day_col).cast("int").alias("_day"), host_of(url).alias("_host"), segment_of(url).alias("_seg"), F.monotonically_increasing_id().alias("_row"))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    keys = F.concat(F.array(F.concat(F.lit("host:"), "_host"), F.concat(F.lit("prefix:"), "_host", F.lit("/"), "_seg")), suffixes)
    looked = keyed.withColumn("_pattern", F.explode(keys)).withColumn("_span", F.expr(f"_day div {SPAN}"))
    last = captures.agg(F.max(F.col(day_col).cast("int"))).first()[0] or 0
    spans = validity_intervals(entries).withColumn("_last", F.least(F.coalesce(F.col("until") - 1, F.lit(last)), F.lit(last))).where("since <= _last")
    spans = spans.withColumn("_in", F.explode(F.sequence(F.expr(f"since div {SPAN}"), F.expr(f"_last div {SPAN}"))))
    on = (F.col("_pattern") == F.col("pattern")) & (F.col("_span") == F.col("_in")) & (F.col("_day") >= F.col("since")) & (F.col("until").isNull() | (F.col("_day") < F.col("until")))
    met = looked.join(spans, on, "left")
    out = met.groupBy("_row").agg(F.first("_id").alias(id_col), F.first("_host").alias("host"), F.count("list").alias("n_active"), F.collect_set("list").alias("_lists"))
    return out.select(id_col, "host", "n_active", (F.col("n_active") > 0).alias("blocked"), F.array_join(F.array_sort("_lists"), ",").alias("lists"))
