"""Consistent-hash ring with virtual nodes and bounded loads: what a full shard can't take goes on clockwise.

The ring has CELLS cells. Every shard owns the arcs that end at its virtual nodes; a row stands at the cell of its key's
hash. Sizes are added up by cell, so the walk round the ring, which needs them in order, is over a table of constant
size; the rows are then placed by joins and windows over single cells.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Cells of the ring.
CELLS = 1 << 16
#: Virtual nodes of a shard.
NODES = 64
#: A shard takes rows until it has this much more than an equal share.
SLACK = 0.001
#: Rows of at least an equal share over HEAVY are placed one by one, before all others: at most HEAVY for each shard.
HEAVY = 256
#: A cell with over one HOT-th of all bytes is cut in SUBS by hashes of its rows' numbers, so that one key may have any number of rows.
HOT, SUBS = 64, 4096
#: End of a piece.
END = 1 << 62


def ring(n_shards: int, nodes: int = NODES, cells: int = CELLS) -> dict[int, int]:
    """Cell of each virtual node, with its shard. A node that meets another goes to the next free cell.

    Shards are laid in order, so that one more shard leaves the nodes of the others where they are.
    """
    if n_shards * nodes > cells // 2:
        raise ValueError("more virtual nodes than half the cells: choose more cells")
    at: dict[int, int] = {}
    for shard in range(n_shards):
        for node in range(nodes):
            cell = zlib.crc32(f"{shard}:{node}".encode()) % cells
            while cell in at:
                cell = (cell + 1) % cells
            at[cell] = shard
    return at


def walk(pieces: list[tuple[int, int, int]], heavy: list[tuple[int, int, int]], total: int, n_shards: int, nodes: int = NODES, slack: float = SLACK, cells: int = CELLS) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """Who gets what: the bounded walk over the ring's cells.

    pieces has (cell, sub, bytes) in ring order without the heavy rows, heavy has (uid, cell, bytes) in the order in
    which they are placed. Returns stretches (cell, sub, from, to, shard) of bytes within a piece, and (uid, shard).

    Heavy rows go to the first shard clockwise that has room for all of it, or else to the one with the least load.
    Then every shard takes the bytes of its own arcs, in ring order, until it is full; what it can't take stands
    in a queue that is carried clockwise, twice round at most, and every shard on the way takes from its front
    while it has room.
    """
    tokens = ring(n_shards, nodes, cells)
    order = sorted(tokens)
    cap = math.ceil((1 + slack) * total / n_shards)
    after = [0] * cells  # the virtual node that a cell belongs to
    k = 0
    for cell in range(cells):
        while k < len(order) and order[k] < cell:
            k += 1
        after[cell] = k % len(order)
    load = [0] * n_shards
    single: list[tuple[int, int]] = []
    for uid, cell, size in heavy:
        first = after[cell]
        way = (tokens[order[(first + j) % len(order)]] for j in range(len(order)))
        shard = next((s for s in way if load[s] + size <= cap), None)
        if shard is None:
            shard = min(range(n_shards), key=lambda s: (load[s], s))
        load[shard] += size
        single.append((uid, shard))
    out: list[tuple[int, int, int, int, int]] = []
    left: dict[int, list[tuple[int, int, int, int]]] = {}
    for cell, sub, size in pieces:
        shard = tokens[order[after[cell]]]
        own = max(0, min(size, cap - load[shard]))
        if own:
            out.append((cell, sub, 0, own, shard))
            load[shard] += own
        if own < size:
            left.setdefault(cell, []).append((cell, sub, own, size))
    queue: deque[tuple[int, int, int, int]] = deque()
    for turn in range(2):
        for cell in range(cells):
            if turn == 0:
                queue.extend(left.get(cell, ()))
            if cell in tokens:
                shard = tokens[cell]
                while queue and load[shard] < cap:
                    c, sub, a, b = queue.popleft()
                    got = min(b - a, cap - load[shard])
                    out.append((c, sub, a, a + got, shard))
                    load[shard] += got
                    if a + got < b:
                        queue.appendleft((c, sub, a + got, b))
    if queue:
        raise RuntimeError("no room left on the ring")
    return out, single


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A bounded list as a table, parsed where Spark runs."""
    text = F.lit(json.dumps(rows))
    fields = [f.split() for f in schema.split(", ")]
    parsed = F.from_json(text, "array<array<bigint>>")
    one = spark.range(1).select(F.explode(parsed).alias("r"))
    return one.select(*[F.get("r", F.lit(k)).cast(t).alias(c) for k, (c, t) in enumerate(fields)])


def _runs(stretches: list[tuple[int, int, int, int, int]], pieces: dict[tuple[int, int], int], large: set[int]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Stretches as (cell, last cell, sub, last sub, from, to, shard): whole neighbours of one shard are one row."""
    out: list[tuple[int, int, int, int, int, int, int]] = []
    for cell, sub, a, b, shard in sorted(stretches):
        end = END if b == pieces[cell, sub] else b
        if out and a == 0 and end == END:
            c0, c1, s0, s1, a0, b0, before = out[-1]
            if before == shard and a0 == 0 and b0 == END:
                if cell not in large and c1 not in large:
                    out[-1] = (c0, cell, 0, 0, 0, END, shard)  # cells between are empty
                    continue
                if cell == c0 == c1:
                    out[-1] = (c0, c1, s0, sub, 0, END, shard)
                    continue
        out.append((cell, cell, sub, sub, a, end, shard))
    return out


def assign(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, nodes: int = NODES, slack: float = SLACK, cells: int = CELLS, heavy: int = HEAVY, hot: int = HOT, subs: int = SUBS) -> DataFrame:
    """One row a document: (doc_id, size, text_crc32, shard, slot).

    A row's size is the UTF-8 bytes of its text (null: none) and `overhead`; its place on the ring is a hash of its id
    alone (null is an id). No shard takes rows once it has (1 + slack) times an equal share, and all are filled by
    what flows over, so the sizes are near equal; a row lies where its first byte lies, and a row that is larger
    than a shard's share has a shard of its own. `slot` numbers the rows of a shard from 0. Repeated rows are rows
    each and may go to different shards when a shard is full; which of two equal rows goes where doesn't matter.
    Texts are measured whole, an empty table gives no rows, and other columns aren't read, whatever their names.

    Plan: one scan writes (id, size, checksum, cell); sums by cell (CELLS at most, and SUBS for each of at most HOT
    cells with a large part of all bytes) and the heavy rows (HEAVY for each shard at most) come to the driver, which
    walks the ring over them. Rows are placed in one shuffle by cell: running sums within a cell, an equi-join on
    the cell with the stretches, and slots from counts by cell.
    """
    if overhead < 1:
        raise ValueError("a row without a byte has no place: overhead is 1 at least")
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    spot = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = rows.select("*", spot.alias("spot"), F.pmod(spot, F.lit(cells)).cast("int").alias("cell"), F.monotonically_increasing_id().alias("uid"))
    try:
        rows = scratch.save(rows, "rows")
        total = rows.agg(F.sum("size")).first()[0] or 0
        least = max(1, math.ceil(total / (n_shards * heavy)))
        single = [(r.uid, r.cell, r.size) for r in rows.where(F.col("size") >= least).select("uid", "cell", "size", "spot", "doc_id").orderBy(F.desc("size"), "spot", "doc_id", "uid").collect()]
        light = rows.where(F.col("size") < least)
        by_cell = {r.cell: r.bytes for r in light.groupBy("cell").agg(F.sum("size").alias("bytes")).collect()}
        large = sorted(c for c, n in by_cell.items() if n * hot > total)
        sub = F.pmod(F.xxhash64("uid"), F.lit(subs)).cast("int")
        light = light.withColumn("sub", F.when(F.col("cell").isin(large), sub).otherwise(0) if large else F.lit(0))
        pieces = [(c, 0, n) for c, n in by_cell.items() if c not in set(large)]
        if large:
            pieces += [tuple(r) for r in light.where(F.col("cell").isin(large)).groupBy("cell", "sub").agg(F.sum("size")).collect()]
        stretches, placed = walk(sorted(pieces), single, total, n_shards, nodes, slack, cells)
        runs = _runs(stretches, {(c, k): n for c, k, n in pieces}, set(large))
        own = _table(spark, runs, "_c0 int, _c1 int, _s0 int, _s1 int, _from bigint, _to bigint, shard int")
        own = own.withColumn("_cell", F.explode(F.sequence("_c0", "_c1"))).withColumn("_sub", F.explode(F.sequence("_s0", "_s1"))).drop("_c0", "_c1", "_s0", "_s1")
        w = W.partitionBy("cell", "sub").orderBy("spot", "doc_id", "uid")
        begins = F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        light = light.withColumn("_begins", begins)
        on = (F.col("cell") == F.col("_cell")) & (F.col("sub") == F.col("_sub")) & (F.col("_begins") >= F.col("_from")) & (F.col("_begins") < F.col("_to"))
        light = light.join(own.hint("merge"), on).select("doc_id", "size", "text_crc32", "shard", "cell", "sub", "spot", "uid")
        if placed:
            alone = _table(spark, placed, "_uid bigint, shard int")
            # heavy rows have a piece of their own in their shard, before all cells
            big = rows.where(F.col("size") >= least).join(F.broadcast(alone), F.col("uid") == F.col("_uid"))
            light = light.unionByName(big.select("doc_id", "size", "text_crc32", "shard", F.lit(-1).alias("cell"), F.lit(0).alias("sub"), "spot", "uid"))
        at = F.row_number().over(W.partitionBy("cell", "sub", "shard").orderBy("spot", "doc_id", "uid"))
        laid = scratch.save(light.withColumn("_k", at.cast("long") - 1), "laid")
        counts = laid.groupBy("shard", "cell", "sub").agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(W.partitionBy("shard").orderBy("cell", "sub").rowsBetween(W.unboundedPreceding, -1))
        counts = counts.select("shard", "cell", "sub", F.coalesce(before, F.lit(0)).alias("_before"))
        out = laid.join(counts.hint("merge"), ["shard", "cell", "sub"])
        return scratch.save(out.select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_k")).alias("slot")), "result")
    finally:
        scratch.drop_but("result")


def shard_sizes(placed: DataFrame) -> DataFrame:
    """Rows and bytes of each shard."""
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def moved(before: DataFrame, after: DataFrame, on: str = "doc_id") -> DataFrame:
    """Bytes and rows that lie elsewhere under another number of shards. Needs unique ids."""
    b, a = before.select(on, "size", F.col("shard").alias("_b")), after.select(on, F.col("shard").alias("_a"))
    other = F.col("_a") != F.col("_b")
    return b.join(a, on).agg(F.count_if(other).alias("rows"), F.sum(F.when(other, F.col("size")).otherwise(0)).alias("bytes"), F.count("*").alias("all_rows"), F.sum("size").alias("all_bytes"))
