"""Exact deduplication by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of characters. The
distinct blocks are sorted into integer names; adjacent names are paired, the
distinct pairs are sorted into integer names again, and so on until every
document has one name. Two documents have one (level, name) exactly if their
texts are equal, as every step is injective:

* Blocks meet by a 128-bit digest, so that their text is shuffled once. The
  distinct (digest, block) rows are checked: a digest that stands for two
  blocks makes the run start again with another seed.
* Pairs of names are compared as such.

Names are numbers in sorted order within a hash bucket, so they depend on the
data alone. All of it is DataFrame code. Groups are only ever counted or
joined, never collected, so one text may be as frequent as it likes: partial
aggregation folds it before the shuffle, and the joins can be split by AQE.

Defined results: null text counts as empty; equal rows belong to one group and
each comes out; a null doc_id is smaller than any other; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, release

BLOCK_CHARS = 4096
BUCKETS = 1 << 20


def _rank_names(keys: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct rows ``keys`` with ``name``: bucket and place in sorted order."""
    bucket = F.pmod(F.xxhash64(*cols), F.lit(BUCKETS))
    order = Window.partitionBy("bucket").orderBy(*cols)
    return (
        keys.withColumn("bucket", bucket)
        .withColumn("name", F.col("bucket") * F.lit(1 << 40) + F.row_number().over(order))
        .drop("bucket")
    )


def _digest(block: Column, seed: int, bits: int) -> tuple[Column, Column]:
    """Two hashes of a block; ``bits`` below 64 exists to test clashes."""
    first, second = F.xxhash64(F.lit(seed), block), F.xxhash64(block, F.lit(~seed))
    if bits < 64:
        return F.pmod(first, F.lit(1 << bits)), F.lit(0).cast("long")
    return first, second


def _blocks(texts: DataFrame, block_chars: int) -> DataFrame:
    """The columns of ``texts`` but norm, and n, idx and block: the blocks of every text; an empty text has one."""
    cut = F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    own = [c for c in texts.columns if c != "norm"]
    cut = texts.withColumn("blocks", cut).withColumn("n", F.greatest(F.size("blocks"), F.lit(1)))
    rows = cut.select(*own, "n", F.posexplode_outer("blocks").alias("idx", "block"))
    return rows.withColumns({"idx": F.coalesce("idx", F.lit(0)), "block": F.coalesce("block", F.lit(""))})


def block_names(
    docs: DataFrame, block_chars: int = BLOCK_CHARS, digest_bits: int = 64
) -> DataFrame:
    """(doc, tag, sha, level, name) for each row of ``docs`` (doc_id, text)."""
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select(F.col("doc_id").alias("doc"), norm.alias("norm"))
    seed = 0
    while True:
        first, second = _digest(F.col("block"), seed, digest_bits if seed == 0 else 64)
        blocks = _blocks(texts, block_chars).select(first.alias("d1"), second.alias("d2"), "block").distinct()
        kinds = materialize(blocks.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("kinds")), "block-kinds")
        if kinds.filter("kinds > 1").isEmpty():
            break
        release(kinds)
        seed += 1
    # A second pass over the texts, the last: digests of blocks, and of the text beside its first block.
    whole = texts.withColumns({"tag": F.xxhash64("norm"), "sha": F.sha2("norm", 256)})
    rows = _blocks(whole, block_chars).withColumns({"d1": first, "d2": second, "sha": F.when(F.col("idx") == 0, F.col("sha"))}).drop("block")
    rows = materialize(rows, "block-digests")
    names = _rank_names(kinds.select("d1", "d2"), ["d1", "d2"])
    current = rows.drop("sha").join(names, ["d1", "d2"])
    current = materialize(current.select("doc", "tag", "n", "idx", "name"), "block-names")
    release(kinds)
    level, done = 0, []
    longest = current.agg(F.max("n")).first()[0] or 0
    while True:
        done.append(current.filter("n = 1").select("doc", "tag", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        pairs = (
            current.filter("n > 1")
            .groupBy("doc", "tag", "n", F.expr("idx div 2").cast("int").alias("idx"))
            .agg(
                F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        pairs = materialize(pairs, "block-pairs")
        names = _rank_names(pairs.select("a", "b").distinct(), ["a", "b"])
        current = materialize(
            pairs.join(names, ["a", "b"]).select("doc", "tag", F.expr("cast((n + 1) div 2 as int)").alias("n"), "idx", "name"),
            "block-names",
        )
        level, longest = level + 1, (longest + 1) // 2
    ids = done[0]
    for part in done[1:]:
        ids = ids.unionByName(part)
    ids = ids.distinct()
    meta = rows.filter("idx = 0").select("doc", "tag", "sha")
    return meta.join(ids, meta["doc"].eqNullSafe(ids["doc"]) & (meta["tag"] == ids["tag"])).select(
        meta["doc"], meta["tag"], "sha", "level", "name"
    )


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS, digest_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; of repeated rows with
    that doc_id all are marked kept, as they are the same document.
    """
    ids = materialize(block_names(docs, block_chars, digest_bits), "block-ids")
    groups = ids.groupBy("level", "name").agg(
        F.max("doc").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    # Written, so that the join has two plain sides: the rows of a very large group can be split then.
    groups = materialize(groups, "groups")
    return ids.join(groups, ["level", "name"]).select(
        F.col("doc").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("doc").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
