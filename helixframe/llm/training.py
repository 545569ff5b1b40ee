"""Bounded, deterministic samples of labelled rows.  Models are fitted from these alone, on the driver or in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved

#: A sample holds so many characters at most.  It is filled in its fixed order with every row that still has room.
MAX_SAMPLE_CHARS = 24_000_000


def crc_remainder(doc_id: str, m: int) -> Column:
    """crc32 of the id as text, modulo m."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(m))


def place(target: str) -> list[Column]:
    """The order of a sample's rows."""
    return [F.xxhash64("_id"), F.col("_id"), F.xxhash64("text"), F.col(target)]


def rows_with_room(rows: DataFrame, target: str, max_rows: int, max_chars: int = MAX_SAMPLE_CHARS) -> DataFrame:
    """The first max_rows of rows(_id, text, target) by hash of _id, as far as max_chars allows, in no order.

    The lengths alone are ordered; the texts that have room are read after.
    """
    rows = saved(rows.select("_id", "text", target))
    room, ids = max_chars, set()
    for r in rows.select("_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"), target).orderBy(F.xxhash64("_id"), "_id", "h", target).limit(max_rows).collect():
        if r["n"] <= room:
            room -= r["n"]
            ids.add((r["_id"], r["h"], r[target]))
    picked = rows.sparkSession.createDataFrame(sorted(ids), f"_id long, h long, {target} {rows.schema[target].dataType.simpleString()}")
    got = rows.join(F.broadcast(picked), (rows["_id"] == picked["_id"]) & (F.xxhash64("text") == picked["h"]) & (rows[target] == picked[target]), "left_semi")
    return got.dropDuplicates()


def with_room(rows: DataFrame, target: str, max_rows: int, max_chars: int = MAX_SAMPLE_CHARS) -> list[tuple]:
    """(text, target) of rows_with_room, in their order."""
    return [(r["text"], r[target]) for r in rows_with_room(rows, target, max_rows, max_chars).orderBy(*place(target)).collect()]


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, folds: int | None = None) -> DataFrame:
    """At most max_rows rows (_id, text, _y) with a label: those with the smallest hashes of doc_id.

    Rows whose crc32(doc_id) mod `folds` is 0 are never drawn.  Null labels and null texts are left out.  The drawn ids
    number max_rows at most, so they are broadcast; the documents are read once and not shuffled.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y is not null")
    if folds:
        rows = rows.where(crc_remainder("_id", folds) != 0)
    drawn = rows.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text").where(F.col("text").isNotNull())
    return rows_with_room(texts.join(F.broadcast(drawn), F.col("_doc") == F.col("_id")), "_y", max_rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, folds: int | None = None) -> list[tuple[str, int]]:
    """The (text, label) pairs of labelled_rows in a fixed order."""
    return [(r["text"], r["_y"]) for r in labelled_rows(docs, labels, label, max_rows, folds).orderBy(*place("_y")).collect()]
