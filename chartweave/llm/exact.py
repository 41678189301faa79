"""Exact deduplication by deterministic block naming (Karp, Miller and Rosenberg)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartweave.llm.common import SPACE_CLASS, keep_rows, row_key
from chartweave.session import materialise

#: Code points of a block.
BLOCK = 4096


def block_hash(block: Column) -> Column:
    """The hash under which a block is looked up; it never decides equality."""
    return F.xxhash64(block)


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", "")


def _blocks(normal: Column, size: int) -> Column:
    """Fixed-size blocks of a text; an empty text has one empty block."""
    cut = F.regexp_extract_all(normal, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(normal) == 0, F.array(F.lit(""))).otherwise(cut)


def _integers(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Integer names in sort order for the rows of ``distinct``."""
    return distinct.orderBy(*order).withColumn("name", F.monotonically_increasing_id())


def block_names(blocks: DataFrame, hash_of=block_hash) -> tuple[DataFrame, DataFrame | None]:
    """Integer names of the distinct ``block`` values.

    Returns (h, k, name) and, where different blocks share a hash, a table
    (h, block, k) that tells them apart. The blocks themselves are shuffled once,
    after a map-side distinct: a hash under which the whole corpus has a single
    block identifies it, so occurrences look their name up by hash alone.
    """
    distinct = blocks.select(hash_of(F.col("block")).alias("h"), "block").distinct()
    found = materialise(_integers(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("texts")), ["h"]))
    shared = found.where("texts > 1").select("h")
    names = found.where("texts = 1").select("h", F.lit(0).alias("k"), "name")
    if shared.isEmpty():
        return names, None
    rank = F.row_number().over(Window.partitionBy("h").orderBy("block"))
    clash = materialise(
        blocks.select(hash_of(F.col("block")).alias("h"), "block").join(shared, "h", "left_semi").distinct()
        .withColumn("k", rank)
    )
    more = materialise(_integers(clash.select("h", "k"), ["h", "k"]))
    return names.unionByName(more.select("h", "k", (-1 - F.col("name")).alias("name"))), clash


def identities(docs: DataFrame, block: int = BLOCK, hash_of=block_hash) -> DataFrame:
    """One collision-free identity per row: (rid, doc_id, text_key, n_points, text_sha256, level, name).

    Normalised texts are cut into blocks of ``block`` code points, which get
    integer names; adjacent names are paired and the pairs named again (an odd
    last name pairs with none) until one name is left. Two rows have equal
    normalised texts exactly if level and name are equal.
    """
    normal = docs.select(*row_key(), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
                         _normal(F.col("text")).alias("_normal"))
    cut = normal.withColumn("_blocks", _blocks(F.col("_normal"), block))
    names, clash = block_names(cut.select(F.explode("_blocks").alias("block")), hash_of)

    # rid is written with the rows it numbers, so it never changes afterwards.
    rows = cut.withColumn("text_sha256", F.sha2("_normal", 256)).withColumn("rid", F.monotonically_increasing_id())
    head = ["rid", "doc_id", "text_key", "n_points", "text_sha256"]
    if clash is None:
        hashes = F.transform("_blocks", lambda b: F.struct(hash_of(b).alias("h"), F.lit(0).alias("k")))
        listed = materialise(rows.select(*head, hashes.alias("parts")))
    else:
        flat = rows.select(*head, F.posexplode("_blocks").alias("i", "block")).withColumn("h", hash_of(F.col("block")))
        told = flat.join(clash, ["h", "block"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
        one = F.array_sort(F.collect_list(F.struct("i", "h", "k")))
        listed = materialise(
            told.groupBy(*head).agg(one.alias("parts"))
            .withColumn("parts", F.transform("parts", lambda p: F.struct(p["h"].alias("h"), p["k"].alias("k"))))
        )
    flat = listed.select("rid", F.size("parts").alias("left"), F.posexplode("parts").alias("i", "p"))
    level = materialise(
        flat.select("rid", "left", "i", "p.h", "p.k").join(names, ["h", "k"]).select("rid", "left", "i", "name")
    )
    most = listed.agg(F.max(F.size("parts"))).first()[0] or 0
    done, depth = [level.where("left = 1").select("rid", F.lit(0).alias("level"), "name")], 0
    while most > 1:
        most, depth = (most + 1) // 2, depth + 1
        pairs = level.where("left > 1").groupBy("rid", "left", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.max(F.when(F.col("i") % 2 == 1, F.struct("name")))["name"].alias("b"),
        ).withColumn("odd", F.col("b").isNull()).withColumn("b", F.coalesce("b", F.lit(0)))
        named = _integers(pairs.select("a", "b", "odd").distinct(), ["a", "b", "odd"])
        level = materialise(
            pairs.join(named, ["a", "b", "odd"])
            .select("rid", F.floor((F.col("left") + 1) / 2).cast("int").alias("left"), "i", "name")
        )
        done.append(level.where("left = 1").select("rid", F.lit(depth).alias("level"), "name"))
    ident = done[0]
    for more in done[1:]:
        ident = ident.unionByName(more)
    return listed.select(*head).join(ident, "rid")


def exact_dedup(docs: DataFrame, block: int = BLOCK, hash_of=block_hash) -> DataFrame:
    """A verdict per row of ``docs`` (doc_id, text): which of the equal texts stays.

    Texts are equal when identical after deleting every ``[\\x20\\x09-\\x0D]``. Of
    equal texts the row with the most code points in its original text stays, then
    the smallest doc_id (null last), then any one of fully repeated rows. A null
    text counts as empty; empty texts are equal to each other and to texts of white
    space. Other columns are ignored. An empty table gives an empty result.

    Returns rid, doc_id, keep_id, group_size, kept, text_sha256, text_key.
    """
    ident = materialise(identities(docs, block, hash_of))
    order = F.struct(
        (-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("rid").alias("r")
    )
    # Written first: a join of two tables is one whose hot names adaptive execution can split.
    best = materialise(ident.groupBy("level", "name").agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("group_size")))
    return ident.join(best, ["level", "name"]).select(
        "rid", "doc_id", F.col("_best.d").alias("keep_id"), "group_size", (F.col("rid") == F.col("_best.r")).alias("kept"),
        "text_sha256", "text_key",
    )


def drop_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; all columns stay as they are."""
    return keep_rows(docs, exact_dedup(docs, block).groupBy("doc_id", "text_key").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("kept").cast("long")).alias("stay")
    ))
