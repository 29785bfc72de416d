"""Line dedup by overlapping windows of consecutive lines, with DataFrame functions only.

Every run of three lines is a window. Of equal windows anywhere in the corpus the first by
(doc_id, place) stays; the lines of the others go, overlapping windows merged. Windows are compared
by 128 bits of hash. Lines are split on ``\\n``; a text of fewer than three lines is one window of its own
length, unless it is empty. A null text has no lines. A window that very many documents hold is not brought together: its first place is
sent to where it occurs. Rows equal in doc_id and text are one document: they come out
alike. Null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.llm.skew import join_counted
from gapweave.session import settle_table

WINDOW = 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _window_keys(a: Column, b: Column) -> Column:
    """Two hashes of each window, from two hashes of each line, with the window's place."""

    def one(h: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])

    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - WINDOW, F.lit(0))), lambda i: F.struct(one(a, i).alias("k1"), one(b, i).alias("k2"), i.alias("at")))


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, starts): for each document with repeated windows, where they start, ascending.
    ``mark`` is a hash of the text."""
    lines = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), _lines(text).alias("lines")).where((F.size("lines") >= WINDOW) | (F.get("lines", F.lit(0)) != "") | (F.size("lines") == 2))
    hashed = lines.select("key", "mark", F.transform("lines", lambda x: F.xxhash64(x)).alias("a"), F.transform("lines", lambda x: F.xxhash64(x, F.lit(1))).alias("b"))
    windows = hashed.select("key", "mark", F.inline(_window_keys(F.col("a"), F.col("b")))).select("key", "mark", "at", F.struct("k1", "k2").alias("k"))
    place = F.struct("key", "mark", "at")
    firsts = settle_table(windows.groupBy("k").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "windows")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    later = join_counted(windows, firsts, "k", "n", total).where(F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")))
    return later.groupBy("key", "mark").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (struct of all columns), text, lines, starts (of repeated windows, null if none) and
    kept_lines of every row of ``docs``."""
    found = repeated_windows(docs, key, text).select(F.col("key").alias("_key"), "mark", "starts")
    own = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    joined = own.join(found, F.col("key").eqNullSafe(F.col("_key")) & (F.xxhash64("text") == F.col("mark")), "left")
    split = joined.select("row", "text", "starts", _lines("text").alias("lines"))
    lines, starts = F.col("lines"), F.col("starts")

    def after(k: Column) -> Column:
        """The lines between the k-th window and the next, or the end."""
        begin = F.get(starts, k) + WINDOW
        end = F.coalesce(F.get(starts, k + 1), F.size(lines))
        return F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0)))

    segments = F.concat(F.array(F.slice(lines, F.lit(1), F.get(starts, F.lit(0)))), F.transform(F.sequence(F.lit(0), F.size(starts) - 1), after))
    return split.withColumn("kept_lines", F.when(starts.isNull(), lines).otherwise(F.flatten(segments)))


def spans(starts: Column) -> Column:
    """Maximal runs of removed lines."""
    apart = F.filter(F.sequence(F.lit(1), F.size(starts)), lambda k: F.get(starts, k) > F.get(starts, k - 1) + WINDOW)
    return F.when(starts.isNull(), F.lit(0)).otherwise(F.size(apart) + 1).cast("long")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_spans, kept_sha256 of every row."""
    out = without_repeats(docs.select("doc_id", "text"))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines"))
    return out.select(
        "row.doc_id", n.cast("long").alias("n_lines"), F.when(F.col("text").isNull(), F.lit(0)).otherwise(n - F.size("kept_lines")).cast("long").alias("n_removed"),
        spans(F.col("starts")).alias("n_spans"), F.sha2(F.coalesce(F.array_join("kept_lines", "\n"), F.lit("")), 256).alias("kept_sha256"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept lines as their text, and ``n_chars`` (if there) to match. A document of
    which nothing stays goes; one that was empty or null before stays as it was."""
    out = without_repeats(docs).where(F.col("starts").isNull() | (F.size("kept_lines") > 0))
    changed = F.col("starts").isNotNull()
    text = F.array_join("kept_lines", "\n")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*[F.when(changed, new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
