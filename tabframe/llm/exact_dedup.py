"""Exact copies through an extendible-hash index on shared files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as sf

from tabframe.llm.common import SPACE, fresh_folder, table

#: Index entries that one bucket should hold.
BUCKET_ROWS = 1_000_000
#: Doublings of the directory at most; beyond them buckets only grow, and nothing is lost.
MOST_DOUBLINGS = 20
#: In SQL: what a null id counts as, and a step wider than any distance of ids.
NO_ID, STEP = "cast(9223372036854775807 as decimal(20,0))", "cast('18446744073709551616' as decimal(38,0))"


def normalised(text):
    """The text without ASCII white space; null is empty."""
    return sf.regexp_replace(sf.coalesce(text, sf.lit("")), SPACE, "")


def directory(keys: DataFrame, rows: int = BUCKET_ROWS, most: int = MOST_DOUBLINGS) -> list[tuple[int, int]]:
    """The extendible-hash directory: for each of its 2 ** depth slots, (bucket's prefix, bucket's depth).

    ``keys`` has a column ``h``. The directory doubles while a bucket is overfull; only overfull buckets split. Counts
    of the slots come to the driver: their number is bounded by 2 ** ``most``, and about twice the keys over ``rows``.
    """
    total, depth = keys.count(), 0
    while depth < most and total > rows << depth:
        depth += 1
    while True:
        # bigint shifts: the highest bits of the hash are the slot
        slot = sf.shiftrightunsigned("h", 64 - depth) if depth else sf.lit(0).cast("long")
        found = dict(keys.groupBy(slot.alias("slot")).count().collect())
        if depth >= most or max(found.values(), default=0) <= rows:
            break
        depth += 1
    slots, at = [], 0
    while at < 1 << depth:
        # the widest bucket that starts here and isn't overfull
        local = next(d for d in range(depth + 1) if at % (1 << depth - d) == 0 and (
            d == depth or sum(found.get(i, 0) for i in range(at, at + (1 << depth - d))) <= rows))
        width = 1 << depth - local
        slots += [(at >> depth - local, local)] * width
        at += width
    return slots


def exact_copies(docs: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256, n_code_points.

    Texts are equal when identical without ASCII white space (null is empty). Of equal texts the one with the most code
    points in the original stays, then the smallest doc_id. ``docs`` needs doc_id and text; other columns, whatever
    their names, are not looked at. A null doc_id counts as larger than any other. Repeated rows count as copies;
    those with the id that stays are all kept. An empty table gives no rows.

    The index is a table in the shared folder, one folder for each bucket of the extendible-hash directory. Its entries
    are distinct texts: copies are merged where they are read, then meet at the owner of their key's bucket, where
    the texts themselves are compared, so texts whose hashes collide are chained as entries of their own.
    """
    spark = docs.sparkSession
    text = normalised(sf.col("text"))
    read = docs.select(
        sf.col("doc_id").cast("long").alias("doc_id"), text.alias("body"),
        sf.length(sf.coalesce("text", sf.lit(""))).cast("long").alias("points"))
    read = read.select("doc_id", "points", "body", sf.xxhash64("body").alias("h"))
    # one number that is largest for the document that stays, of a type that aggregates without sorting
    rank = sf.expr(f"cast(cast(points as decimal(38,0)) * {STEP} + ({NO_ID} - coalesce(doc_id, {NO_ID})) as decimal(38,0))")
    distinct = read.select("h", "body", rank.alias("rank")).groupBy("h", "body").agg(
        sf.max("rank").alias("rank"), sf.count("*").alias("group_size"))
    keep = sf.expr(f"cast({NO_ID} - rank % {STEP} as bigint)")
    entries = distinct.select("h", sf.sha2("body", 256).alias("text_sha256"), keep.alias("keep_id"), "group_size")
    path = fresh_folder(spark, "copy-index")
    entries.write.parquet(f"{path}/entries")
    entries = spark.read.schema(entries.schema).parquet(f"{path}/entries")
    slots = directory(entries.select("h"), rows)
    depth = (len(slots) - 1).bit_length()
    names = sf.array(*(sf.lit(f"{p:0{d}b}" if d else "all") for p, d in slots)) if depth <= 8 else None
    slot = sf.shiftrightunsigned("h", 64 - depth) if depth else sf.lit(0).cast("long")
    if len(set(slots)) > 1:
        # bucket files: each owner has a range of keys, and writes to the buckets that the range meets
        bucket = names[slot.cast("int")] if names is not None else sf.lpad(sf.bin(slot), depth, "0")
        entries.repartitionByRange(max(len(set(slots)), 1), "h").withColumn("bucket", bucket).write.partitionBy(
            "bucket").parquet(f"{path}/buckets")
        entries = spark.read.parquet(f"{path}/buckets").drop("bucket")
    mine = read.select("doc_id", "points", "h", sf.sha2("body", 256).alias("text_sha256"))
    return mine.join(entries, ["h", "text_sha256"]).select(
        "doc_id", sf.expr(f"if(keep_id = {NO_ID}, null, keep_id)").alias("keep_id"), "group_size",
        sf.expr(f"cast(coalesce(doc_id, {NO_ID}) as bigint) = keep_id").alias("kept"),
        "text_sha256", sf.col("points").alias("n_code_points"))


def unique(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of equal texts, with the columns of ``docs``.

    Of equal texts the one with the most code points stays, then the smallest doc_id, as in ``exact_copies``; a null text is
    empty, so one of all null and blank texts stays. Rows that repeat an id and a text that stay are all kept, as are rows
    without id of which one stays. Texts are compared whole. An empty table gives no rows. Columns may have any names.
    """
    keep = exact_copies(docs).where("kept").select("doc_id", "text_sha256").distinct().alias("keep")
    mine = docs.alias("docs")
    own = [sf.col("docs.doc_id").cast("long").eqNullSafe(sf.col("keep.doc_id")),
           sf.sha2(normalised(sf.col("docs.text")), 256) == sf.col("keep.text_sha256")]
    return mine.join(keep, own, "left_semi")


def op4_exact_dedup(spark, sf_dir):
    return exact_copies(table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (select doc_id, length(coalesce(text, '')) as n_code_points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over w as kept, text_sha256, n_code_points
from d window w as (partition by text_sha256 order by n_code_points desc, doc_id)
"""
