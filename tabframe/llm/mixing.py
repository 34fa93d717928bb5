"""Mixing sources to target weights by highest quotients."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as sf

from tabframe.llm.common import SPACE, table, written

#: Words in a block, the unit that is handed out.
BLOCK = 32
#: Words that one shard should hold, all sources together.
SHARD_WORDS = 50_000
#: How often a document may be taken.
MOST_REPEATS = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
SEED = 20_240_607


def fill(sizes, weights, most=MOST_REPEATS):
    """Shares of sum(sizes) by weight; none above ``most`` times its size, the excess shared again by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    target, open_, left = np.zeros(len(sizes)), sizes > 0, float(sizes.sum())
    while open_.any():
        share = np.where(open_, left * weights / weights[open_].sum(), 0)
        over = open_ & (share > most * sizes)
        if not over.any():
            return np.where(open_, share, target)
        target[over] = most * sizes[over]
        left -= target[over].sum()
        open_ &= ~over
    return target


def highest_quotients(votes, seats: int, most=None) -> np.ndarray:
    """Sainte-Laguë: seats go one by one to the highest votes / (2 * seats so far + 1); ties to the earlier entry.

    ``most`` caps each entry. A common divisor is searched first, which gives all but a few seats at once; those few
    are then given or taken back by quotient.
    """
    votes = np.asarray(votes, float)
    most = np.full(len(votes), seats, np.int64) if most is None else np.asarray(most, np.int64)
    most = np.where(votes > 0, most, 0)
    seats = int(min(seats, most.sum()))
    given = lambda x: np.minimum(np.floor(votes * x + 0.5).astype(np.int64), most)
    low, high = 0.0, 1.0
    if not seats:
        return np.zeros(len(votes), np.int64)
    high = 1 / votes[votes > 0].max()
    while given(high).sum() < seats:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if given(mid).sum() < seats else (low, mid)
    out = given(low)
    while (lack := seats - int(out.sum())) > 0:
        quotient = np.where(out < most, votes / (2 * out + 1), -1)
        best = np.argsort(-quotient, kind="stable")[:lack]
        best = best[quotient[best] >= quotient.max() * (1 - 1e-12)]
        out[best] += 1
    return out


def _quotas(part: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one source, dealt to its shards."""
    part = part.sort_values("shard")
    part["quota"] = highest_quotients(part["words"], int(part["seats"].iloc[0]), MOST_REPEATS * part["blocks"])
    return part[["rank", "shard", "blocks", "quota"]]


def _chosen(block: str) -> str:
    """SQL: whether a block is among those taken once more. The step is a prime larger than any number of blocks, so
    it visits each block once."""
    return f"(pmod({block} * 1500450271L + shift, blocks) < rest)"


def _placed(docs: DataFrame, carry: list[str], seed: int, shard_words: int) -> DataFrame:
    """The columns ``carry`` in a struct ``row`` beside size, source_size, target, the row's place in its shard's
    stream (start, end) and how often blocks are taken there (all, rest, blocks, shift)."""
    text = sf.coalesce("text", sf.lit(""))
    words = sf.size(sf.split(sf.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+"))
    size = sf.when(text.rlike(r"[^\x20\x09-\x0D]"), words).otherwise(0).cast("long")
    # rows with one id but other texts stay apart
    order = sf.xxhash64(sf.lit(seed), "doc_id", "text")
    rows = docs.select(sf.struct(*carry).alias("row"), sf.col("source"), size.alias("size"), order.alias("order"))
    # one row per source: a summary, small beside the corpus
    sources = rows.groupBy("source").agg(sf.sum("size").alias("source_size")).toPandas()
    sources["none"] = sources["source"].isna()
    sources = sources.sort_values(["none", "source"]).reset_index(drop=True)
    sources["target"] = fill(sources["source_size"], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))])
    total = int(sources["source_size"].sum()) if len(sources) else 0
    sources["seats"] = highest_quotients(sources["target"], round(total / BLOCK))
    dealt = docs.sparkSession.createDataFrame(
        [(None if none else source, rank, int(size), float(target), int(seats)) for rank, (source, size, none, target, seats)
         in enumerate(sources.itertuples(index=False))],
        "source string, rank long, source_size long, target double, seats long")
    shard = sf.pmod(sf.xxhash64(sf.lit(seed + 1), "order"), sf.lit(max(1, total // shard_words)))
    rows = rows.withColumn("shard", shard).alias("r").join(
        dealt.alias("s"), sf.col("r.source").eqNullSafe(sf.col("s.source"))).drop("source")
    sums = rows.groupBy("rank", "shard").agg(sf.sum("size").alias("words"), sf.first("seats").alias("seats"))
    sums = sums.withColumn("blocks", sf.ceil(sf.col("words") / BLOCK).cast("long"))
    quotas = written(sums.groupBy("rank").applyInPandas(_quotas, "rank long, shard long, blocks long, quota long"), "quotas")
    within = Window.partitionBy("rank", "shard").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", sf.sum("size").over(within)).join(quotas, ["rank", "shard"])
    return placed.withColumns({
        "start": sf.col("end") - sf.col("size"),
        "all": sf.when(sf.col("blocks") > 0, sf.expr("quota div blocks")).otherwise(sf.lit(0)),
        "rest": sf.when(sf.col("blocks") > 0, sf.expr("quota % blocks")).otherwise(sf.lit(0)),
        "shift": sf.pmod(sf.xxhash64(sf.lit(seed + 2), "rank", "shard"), sf.lit(2**31 - 1)),
    })


def mix(docs: DataFrame, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken.

    A document's size is its number of words; null text has none. Sources, null last, weigh 5, 2, 1, repeating, in
    the order of their code points. Shares of all words go by weight; no source gets more than three times its
    size. Documents without words take part with size 0; sources without words have the target 0. Columns other than
    doc_id, text and source, whatever their names, are not looked at. An empty table gives no rows.

    A source's documents lie end to end in seeded order in each shard and are cut into blocks of equal length. The
    blocks due to a source, and then those due to each of its shards, are handed out by highest quotients. A shard
    takes all its blocks as often as the quota allows, and the rest by a seeded choice. Words of a document that
    lie in the blocks taken are ``taken``; a block is taken three times at most. Ids and texts alone decide the
    seeded order, so reruns agree; rows alike in both may change places with each other.
    """
    placed = _placed(docs, ["doc_id"], seed, shard_words)
    taken = sf.when(sf.col("size") > 0, sf.expr(f"""aggregate(
        sequence(start div {BLOCK}, (end - 1) div {BLOCK}), 0L, (sum, b) -> sum
          + (least(end, (b + 1) * {BLOCK}) - greatest(start, b * {BLOCK})) * (all + if({_chosen('b')}, 1, 0)))"""))
    return placed.select("row.doc_id", "size", "source_size", "target", sf.coalesce(taken, sf.lit(0).cast("long")).alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time that a document is taken.

    A document whose blocks are taken k times is there k times, whole; where some of its blocks are taken once more,
    another row has the words of those blocks with the white space after each, and n_chars, if there is one, is new.
    """
    placed = _placed(docs, docs.columns, seed, shard_words)
    word = sf.expr(r"regexp_extract_all(row.text, '([^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*)', 1)")
    placed = placed.where("size > 0 and (all > 0 or rest > 0)").withColumn("words", sf.when(sf.col("rest") > 0, word))
    part = sf.expr(f"filter(words, (w, i) -> {_chosen(f'((start + i) div {BLOCK})')})")
    placed = placed.withColumn("part", sf.coalesce(part, sf.array().cast("array<string>"))).drop("words")
    cut = sf.when(sf.size("part") == sf.col("size"), sf.col("row.text")).otherwise(sf.array_join("part", ""))
    copies = sf.concat(sf.array_repeat(sf.col("row.text"), sf.col("all").cast("int")), sf.when(
        sf.size("part") > 0, sf.array(cut)).otherwise(sf.array().cast("array<string>")))
    out = placed.select("row", sf.explode(copies).alias("copy"))
    new = {"text": sf.col("copy"), "n_chars": sf.length("copy").cast("long")}
    return out.select(*(new.get(c, sf.col("row")[c]).alias(c) for c in docs.columns))


def op5_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
