"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Equal blocks get the same integer name: the distinct
blocks are sorted and numbered. Then adjacent names are paired, the distinct pairs are sorted and numbered,
and so on until one name is left of each text. Equal names mean equal texts, whatever hash functions do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, staged


def _named(things: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct things with an integer name: their place in the order of those in the same partition."""
    return things.select(*columns).distinct().sortWithinPartitions(*columns).withColumn("name", F.monotonically_increasing_id())


def _block_names_of(occurrences: DataFrame, contents: DataFrame, route) -> DataFrame:
    """occurrences with column block replaced by name; contents: the same blocks alone.

    The bytes of a block cross the network once, to be sorted and numbered; rows find their block's name
    by a 64-bit key, hot keys by broadcast. Should two different blocks have one key, the rows with that key are joined on
    the bytes themselves.
    """
    keyed = occurrences.withColumn("key", route("block"))
    names = staged(_named(contents, ["block"]).select(route("block").alias("key"), "name"), "block-names")
    clashing = names.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rows = keyed.drop("block")
    if clashing.isEmpty():
        return join_hot(staged(rows, "keyed"), names, ["key"]).drop("key")
    clear = rows.join(clashing, "key", "left_anti").join(names, "key").drop("key")
    doubtful = keyed.join(clashing, "key", "left_semi")
    own = _named(doubtful, ["block"]).withColumn("name", -1 - F.col("name"))
    return clear.unionByName(doubtful.join(own, "block").drop("block", "key"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, route=F.xxhash64) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; empty texts are equal to each other. Of equal texts the row with the
    largest id stays (a null id is smaller than any other). If the same id comes twice with equal texts,
    exactly one of those rows has kept = true. Other columns of docs are not looked at. An empty
    table gives an empty result. Texts may be of any length: a text of n blocks takes log2(n) rounds
    of naming, and only names, not bytes, take part in them. Groups may be of any size: join_hot() deals them out.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), body.alias("body"),
    ).withColumn("width", F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(block_bytes))).cast("int"))
    cut = F.expr(f"transform(sequence(0, width - 1), i -> substring(body, i * {block_bytes} + 1, {block_bytes}))")
    contents = rows.select(F.explode(cut).alias("block"))
    occurrences = rows.select("row_id", "doc_id", "width", F.sha2("body", 256).alias("sha"), F.posexplode(cut).alias("pos", "block"))
    occurrences = occurrences.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha")))

    level = staged(_block_names_of(occurrences, contents, route), "names")
    depth, finished = 0, []
    while True:
        finished.append(level.where("width = 1").select("row_id", "doc_id", "sha", F.lit(depth).alias("depth"), "name"))
        rest = level.where("width > 1")
        if rest.isEmpty():
            break
        pairs = staged(
            rest.groupBy("row_id", F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.max("doc_id").alias("doc_id"), F.max("width").alias("width"), F.max("sha").alias("sha"),
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"),
                F.max(F.col("pos") % 2).alias("full"),
            )
            .withColumn("right", F.coalesce("right", F.lit(0))),
            "pairs",
        )
        key = ["left", "right", "full"]
        named = staged(_named(pairs, key), "pair-names")
        level = staged(join_hot(pairs, named, key).select("row_id", "doc_id", "sha", F.shiftright(F.col("width") + 1, 1).alias("width"), "pos", "name"), "names")
        depth += 1

    ids = finished[0]
    for more in finished[1:]:
        ids = ids.unionByName(more)
    groups = ids.groupBy("depth", "name").agg(F.max(F.struct("doc_id", (-F.col("row_id")).alias("first"))).alias("keep"), F.count("*").alias("group_size"))
    return join_hot(ids, staged(groups, "groups"), ["depth", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep.first") == -F.col("row_id")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
