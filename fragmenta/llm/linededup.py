"""Lines that many documents repeat, found and dropped everywhere.

Normalised lines are exploded with their positions and hashed once, into a table of hashes and
positions; distinct documents are counted for each hash; what reaches the threshold is joined
back to that table, and each document is put together again from the positions that stay. Only
hashes and positions are shuffled by line; the texts move once, to meet their document's positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmenta.llm._shared import WHITE, ascii_lower, text_or_empty, written


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _two_hashes(col: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(0), col).alias("a"), F.xxhash64(F.lit(1), col).alias("b"))


def _own_key(key: str) -> Column:
    """The two hashes under an expression of their own, so that a join on them exchanges both sides and a hot key can be split at run time."""
    return F.struct(F.col(f"{key}.a").bitwiseXOR(F.lit(1)), F.col(f"{key}.b"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` replaced, plus n_lines and n_dropped.

    A line goes if its key has at least ``min_chars`` code points and stands in at least
    ``min_docs`` documents, told apart by ``id_col`` (rows with a null id count as one document).
    A null or empty text is one empty line and comes back empty. Repeated rows are each kept and
    count once. A document that loses all lines becomes empty. An empty table gives an empty one.
    Columns of ``docs`` named n_lines or n_dropped are replaced. Lines and rows are told apart by 128
    bits of two hashes.
    """
    text = text_or_empty(text_col)
    lines = F.split(text, "\n", -1)
    row = _two_hashes(F.concat_ws("\x00", F.col(id_col).cast("string"), text))  # equal rows lose equal lines
    keys = F.transform(lines, lambda x: F.btrim(x, F.lit(WHITE)))
    hashes = F.transform(F.transform(keys, ascii_lower), lambda k: F.when(F.char_length(k) >= max(1, min_chars), _two_hashes(k)))
    found = docs.select(F.col(id_col).alias("_id"), row.alias("_row"), F.posexplode(hashes).alias("_pos", "_key")).where("_key IS NOT NULL")
    found = written(found, "line-keys")
    often = found.groupBy("_key", "_id").agg(F.lit(1).alias("_one")).groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_docs)
    often = often.select(_own_key("_key").alias("_often"))
    hits = found.select("_row", "_pos", _own_key("_key").alias("_hash")).join(often, F.col("_hash") == F.col("_often"))
    gone = hits.groupBy("_row").agg(F.collect_set("_pos").alias("_gone")).select(F.col("_row").alias("_of"), "_gone")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>"))), lambda i: F.get("_lines", i))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    met = docs.withColumn("_row", row).join(gone, F.col("_row") == F.col("_of"), "left").withColumn("_lines", lines).withColumn("_kept", kept)
    return met.select(*others, F.array_join("_kept", "\n").alias(text_col), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"))
