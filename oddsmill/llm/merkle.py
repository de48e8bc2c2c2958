"""Merkle manifest of a dataset: each aligned block of leaves keeps a level as one hex string.

A level of a block is the concatenation of its nodes' digests, 64 characters each. Fixed-width substrings of two
digests are hashed to the next level; the digest that flanks a node's own is its sibling. Block roots are the nodes of
the next, shorter tree, and so on until a key has one node; the keys' nodes are then a tree of their own. All of it is
SQL expressions, and no group is larger than a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, growing

#: Levels of a block: 2 to this many leaves.
BLOCK_LEVELS = 10
#: Rows of the table of stretches up to which it is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 100_000
#: Characters of a digest.
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field is `-` where null, else its UTF-8 byte count, a colon and its text."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, fields)).cast("binary"), 256)


def _range(n: Column) -> Column:
    """0 to n - 1, empty where n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("int"), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _digest(level: Column, k: Column) -> Column:
    """The k-th digest of a level (bytes of hex text, so that a substring costs its own length); empty beyond the end."""
    return F.substring(level, (k * HEX + 1).cast("int"), F.lit(HEX))


def _parents(level: Column) -> Column:
    n = F.ceil(F.octet_length(level) / (2 * HEX))
    return F.array_join(F.transform(_range(n), lambda i: F.sha2(F.substring(level, (i * 2 * HEX + 1).cast("int"), F.lit(2 * HEX)), 256)), "").cast("binary")


def _levels(leaves: Column, height: Column) -> Column:
    """All levels of a block, from its leaves up; the last one is its root."""
    return F.aggregate(_range(height), F.array(leaves), lambda found, _: F.concat(found, F.array(_parents(F.element_at(found, -1)))))


def _turns(levels: Column, height: Column, k: Column) -> Column:
    """A character for each level: whether the sibling of node k stands right (R) or left (L) of it, or there is none (-)."""
    one = lambda j: F.when(F.octet_length(_digest(F.get(levels, j), _flank(k, j))) == 0, "-").when(_at(k, j) % 2 == 0, "R").otherwise("L")
    return F.array_join(F.transform(_range(height), one), "")


def _siblings(levels: Column, height: Column, k: Column) -> Column:
    """The digests that flank node k, level by level; nothing where it stands alone."""
    return F.array_join(F.transform(_range(height), lambda j: _digest(F.get(levels, j), _flank(k, j)).cast("string")), "")


def _at(k: Column, j: Column) -> Column:
    return F.call_function("shiftright", k, j)


def _flank(k: Column, j: Column) -> Column:
    return _at(k, j).bitwiseXOR(F.lit(1))


def fold(leaf: Column, turns: Column, siblings: Column) -> Column:
    """The root that a leaf has under a proof."""
    step = F.struct(leaf.alias("h"), F.lit(1).alias("at"))

    def up(s: Column, j: Column) -> Column:
        turn, own = F.substring(turns, j + 1, F.lit(1)), F.substring(siblings, s["at"], F.lit(HEX))
        both = F.when(turn == "R", F.concat(s["h"], own)).when(turn == "L", F.concat(own, s["h"])).otherwise(s["h"])
        return F.struct(F.sha2(both.cast("binary"), 256).alias("h"), (s["at"] + F.when(turn == "-", 0).otherwise(HEX)).alias("at"))

    return F.aggregate(_range(F.length(turns)), step, up)["h"]


def numbered(rows: DataFrame, key: str, order: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with `pos` (0, 1, ... in order within a key) and `n` (rows of the key).

    Rows are sorted by ranges and written once; a key's stretch in a partition starts where the stretches before it
    end, so a key with most of the rows is many tasks. Equal rows may have each other's places.
    """
    laid = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    laid = scratch.save(laid, f"{name}-sorted").withColumn("_part", F.shiftright("_at", 33))
    runs = laid.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    w = W.partitionBy(key)
    before = F.sum("_rows").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select(F.col(key).alias("_key"), F.col("_part").alias("_own"), "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(w).alias("n"))
    runs, n_runs, _ = scratch.save_counted(runs, f"{name}-runs")
    runs = F.broadcast(runs) if n_runs <= BROADCAST_ROWS else growing(runs)
    found = laid.join(runs, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_own")))
    return found.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_key", "_own", "_first", "_before")


def _blocks(nodes: DataFrame, scratch: Scratch, name: str, block_levels: int, payload: Sequence[str] = ()) -> DataFrame:
    """nodes (key, pos, n, hash, payload) folded to blocks: (key, block, n, rows, levels, height)."""
    size = 1 << block_levels
    own = F.struct(F.col("pos").alias("pos"), "hash", *payload)
    b = nodes.groupBy("key", F.floor(F.col("pos") / size).cast("long").alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(own)).alias("rows"))
    # the only block of a key ends at its root; others rise by all their levels
    height = F.when(F.col("n") > size, F.lit(block_levels)).otherwise(F.ceil(F.log2("n")).cast("int"))
    b = b.withColumn("height", height).withColumn("_leaves", F.array_join("rows.hash", "").cast("binary"))
    kept = F.transform("rows", lambda r: F.struct(r["pos"].alias("pos"), *[r[c].alias(c) for c in payload]))
    return scratch.save(b.select("key", "block", "n", "height", kept.alias("rows"), _levels(F.col("_leaves"), F.col("height")).alias("levels")), name)


def _tops(blocks: DataFrame, block_levels: int) -> DataFrame:
    """The blocks' roots as nodes of the next tree."""
    return blocks.select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << block_levels)).cast("long").alias("n"), F.element_at("levels", -1).cast("string").alias("hash"))


def _paths(blocks: DataFrame, above: DataFrame | None, payload: Sequence[str] = ()) -> DataFrame:
    """Each node of the blocks with the turns and siblings from it up, those `above` its block included."""
    if above is not None:
        up = above.select(F.col("key").alias("_key"), F.col("pos").alias("_pos"), F.col("turns").alias("_turns"), F.col("siblings").alias("_siblings"), *[c for c in ("subroot",) if c in above.columns])
        blocks = blocks.join(growing(up), (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_pos")))
    extra = [c for c in ("subroot",) if c in blocks.columns]
    tail = lambda c: F.col(c) if above is not None else F.lit("")
    size = F.size("rows")

    def one(r: Column, k: Column) -> Column:
        levels, height = F.col("levels"), F.col("height")
        turns, siblings = F.concat(_turns(levels, height, k), tail("_turns")), F.concat(_siblings(levels, height, k), tail("_siblings"))
        return F.struct(r["pos"].alias("pos"), _digest(F.get(levels, F.lit(0)), k).cast("string").alias("hash"), turns.alias("turns"), siblings.alias("siblings"), *[r[c].alias(c) for c in payload])

    each = F.when(size > 0, F.transform("rows", one))
    return blocks.select("key", *extra, each.alias("_nodes")).select("key", *extra, F.inline("_nodes"))


def _trees(nodes: DataFrame, scratch: Scratch, name: str, block_levels: int, payload: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, and (key, pos, n, hash) with the one node that each key comes to."""
    rounds: list[DataFrame] = []
    while True:
        rounds.append(_blocks(nodes, scratch, f"{name}-{len(rounds)}", block_levels, payload if not rounds else ()))
        nodes = _tops(rounds[-1], block_levels)
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return rounds, nodes


def manifest(docs: DataFrame, tampered: Column | None = None, key: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS, changed: dict[str, Column] | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Every row's leaf and its proof: (doc_id, leaf, altered, subroot, root, turns, siblings).

    Rows of a key (null is a key, the first one) are leaves in ascending `order`, nulls first, equal ones by their
    digest; a last odd node is hashed alone, a lone leaf is the subroot itself. Subroots in the keys' bytewise order
    are the leaves of the root's tree. `siblings` has the digests from the leaf up to the root, 64 characters each,
    `turns` says for each level whether the sibling stands right (R), left (L) or is missing (-): `fold` makes the root
    of the three. `altered` is the leaf with the expressions of `changed` in place of the fields where `tampered`
    holds, else null. Null fields are marked, texts are hashed whole whatever their length, repeated rows are leaves
    each; an empty table gives no rows. Columns beside the fields are ignored, whatever their names.

    Plan: digests are sorted by ranges of (key, order) and numbered by the stretches' counts; a block is at most 1024
    leaves in one row, so no key is one task; each round of block roots is a thousandth of the one before, and proofs
    are joined downwards, block by block, before the leaves are taken out of their blocks.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    d = docs.select(*[F.col(c) for c in dict.fromkeys([*fields, key, order])])
    other = [(changed or {}).get(c, F.col(c)) for c in fields]
    altered = F.lit(None).cast("string") if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), leaf_hash(other))
    # keys as text that sorts like them: null is empty, others have a mark before them
    leaves = d.select(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("key"), F.col(order).alias("doc_id"), leaf_hash([F.col(c) for c in fields]).alias("hash"), altered.alias("altered"))
    try:
        leaves = numbered(leaves, "key", ["doc_id", "hash"], scratch, "leaves")
        payload = ["doc_id", "altered"]
        rounds, subroots = _trees(leaves, scratch, "tree", block_levels, payload)
        keys = subroots.select(F.lit("").alias("all"), F.col("key").alias("_of"), "hash")
        keys = numbered(keys, "all", ["_of"], scratch, "keys").withColumnRenamed("all", "key")
        upper, top = _trees(keys, scratch, "keys", block_levels, ["_of"])
        root = top.select("hash").first()
        above = None
        for k in range(len(upper) - 1, -1, -1):
            above = _paths(upper[k], above, ["_of"] if k == 0 else ())
        above = above.select(F.col("_of").alias("key"), F.lit(0).cast("long").alias("pos"), F.col("hash").alias("subroot"), "turns", "siblings")
        for k in range(len(rounds) - 1, -1, -1):
            above = _paths(rounds[k], above, payload if k == 0 else ())
        out = above.select("doc_id", F.col("hash").alias("leaf"), "altered", "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "turns", "siblings")
        return scratch.save(out, "result")
    finally:
        scratch.drop_but("result")
