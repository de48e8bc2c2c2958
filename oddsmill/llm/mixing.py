"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over permuted blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, Scratch, growing

#: Blocks of a source, and parts of its one block that is taken in part: the grain is a millionth of a source.
N_BLOCKS = 1024
#: The driver holds a few numbers for each source and shard; beyond this many sources the call is refused.
MAX_SOURCES = 100_000
#: Words of one run of a shard: what one task sorts.
RUN_WORDS = 1 << 25


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Shares of `share` times all sizes by weight; what stands above `most` times a size is dealt again to the rest."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / total > most * sizes[k]}
        if not full:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in full:
            out[k] = most * sizes[k]
        left -= sum(out[k] for k in full)
        open_ -= full
    return out


def splitting_tree(quotas: Sequence[int], n_shards: int, seed: int):
    """Blocks of each source for each shard, [n_shards, n_sources]; every node splits its exact quotas in two."""
    import numpy as np

    out = np.zeros((n_shards, len(quotas)), np.int64)
    nodes = [(0, n_shards, np.asarray(quotas, np.int64))]
    while nodes:
        lo, hi, quota = nodes.pop()
        if hi - lo == 1:
            out[lo] = quota
            continue
        mid = (lo + hi) // 2
        n_left = int(quota.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(quota, n_left, method="marginals") if n_left else 0 * quota
        nodes += [(lo, mid, left), (mid, hi, quota - left)]
    return out


def _fill(words, order, room: float) -> tuple[list[int], int, float]:
    """Parts taken in this order while they fit, the part left over whose size is nearest to the room that stays (or -1), and that room."""
    taken, over = [], []
    for b in order:
        if words[b] == 0:
            continue
        if words[b] <= room:
            taken.append(int(b))
            room -= float(words[b])
        else:
            over.append(int(b))
    return taken, min(over, key=lambda b: abs(words[b] - room), default=-1), room


def _draws(plan: dict, seed: int):
    """Of one source's blocks: for each block its ranks among the blocks drawn, and the one drawn in part."""

    def run(pdf):
        import zlib

        import numpy as np
        import pandas as pd

        key = pdf["src"].iloc[0]
        whole, rest = plan[key]
        words = np.zeros(N_BLOCKS, np.int64)
        words[pdf["block"].to_numpy()] = pdf["words"].to_numpy()
        rng = np.random.default_rng([seed, zlib.crc32(key.encode())])
        ranks: list[list[int]] = [[] for _ in range(N_BLOCKS)]
        n = 0
        for _ in range(whole):
            for b in rng.permutation(N_BLOCKS):
                ranks[b].append(n)
                n += 1
        taken, part, room = _fill(words, rng.permutation(N_BLOCKS), rest)
        for b in taken:
            ranks[b].append(n)
            n += 1
        return pd.DataFrame({"src": key, "block": range(N_BLOCKS), "ranks": ranks, "part_rank": [n if b == part else None for b in range(N_BLOCKS)], "room": room, "quota": n + (part >= 0)}).astype({"part_rank": "Int32"})

    return run


def _parts(seed: int):
    """Of the block drawn in part: the parts of it that are taken, the last one if that comes nearer than none."""

    def run(pdf):
        import zlib

        import numpy as np
        import pandas as pd

        key, room = pdf["src"].iloc[0], float(pdf["room"].iloc[0])
        words = np.zeros(N_BLOCKS, np.int64)
        words[pdf["part"].to_numpy()] = pdf["words"].to_numpy()
        taken, _, room = _fill(words, np.random.default_rng([seed, 1, zlib.crc32(key.encode())]).permutation(N_BLOCKS), room)
        left = [b for b in range(N_BLOCKS) if words[b] and b not in set(taken)]
        if left and abs(room - words[best := min(left, key=lambda b: abs(room - words[b]))]) < room:
            taken.append(best)
        return pd.DataFrame({"src": pd.Series([key] * len(taken), dtype=str), "part": pd.Series(taken, dtype="int32")})

    return run


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, n_shards: int = 64, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How often each document enters the mix, and in which output shards.

    Returns one row for each input row: doc_id, source, size, source_size, target, copies (0 to `most`, rounded
    up), taken (size times copies) and shards (array<int>, one for each copy). Sources in code point order, null
    last as a source of its own, take the weights in turn. A null text has size 0 and is never short of room; a
    source of size 0 has target 0. Rows of one id and source share their block and part, so they are taken
    together; a very long text is one unit of its size. The same table gives the same mix, however it is partitioned; an
    empty table gives no rows.

    Each source's rows fall by a hash of the id into N_BLOCKS blocks. Whole passes and then permuted blocks are
    drawn up to the target, one block only in part (by its own N_BLOCKS parts). The exact block quotas of all
    sources go down the splitting tree to the shards, and a shard owns a run of the permuted blocks of each
    source. What moves is sums for each (source, block), so a source with a third of all rows is no special
    case; the driver sees one row for each source.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    d = d.select("*", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"), F.xxhash64(F.lit(seed), F.col("source"), F.col("doc_id")).alias("h"))
    d = d.select("doc_id", "source", "src", "size", F.shiftrightunsigned("h", 54).cast("int").alias("block"), F.shiftrightunsigned("h", 44).bitwiseAND(N_BLOCKS - 1).cast("int").alias("part"))
    d = scratch.save(d, "sizes")
    blocks = d.groupBy("src", "block").agg(F.sum("size").alias("words"))
    found = blocks.groupBy("src").agg(F.sum("words").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.src == "", r.src))
    sizes = [r.size for r in found]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share, most)
    whole = [int(t // s) if s else 0 for t, s in zip(goal, sizes)]
    plan = {r.src: (n, t - n * s) for r, s, t, n in zip(found, sizes, goal, whole)}
    draws = blocks.groupBy("src").applyInPandas(_draws(plan, seed), "src string, block int, ranks array<int>, part_rank int, room double, quota int")
    draws = scratch.save(draws, "draws")
    quotas = {r.src: r.quota for r in draws.groupBy("src").agg(F.max("quota").alias("quota")).collect()}
    ends = splitting_tree([quotas[r.src] for r in found], n_shards, seed).cumsum(0)
    sources = spark.createDataFrame([(r.src, s, t, ends[:, k].tolist()) for k, (r, s, t) in enumerate(zip(found, sizes, goal))], "src string, source_size long, target double, ends array<long>")
    part = draws.where("part_rank is not null").select("src", "block", "room")
    parts = d.join(part, ["src", "block"]).groupBy("src", "part").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
    parts = scratch.save(parts.groupBy("src").applyInPandas(_parts(seed), "src string, part int"), "parts")
    d = d.join(draws.select("src", "block", "ranks", "part_rank"), ["src", "block"]).join(parts.withColumn("in_part", F.lit(True)), ["src", "part"], "left").join(sources, "src")
    drawn = F.when(F.col("in_part") & F.col("part_rank").isNotNull(), F.concat("ranks", F.array("part_rank"))).otherwise(F.col("ranks"))
    d = d.select("doc_id", "source", "size", "source_size", "target", drawn.alias("drawn"), "ends")
    shards = F.transform("drawn", lambda r: F.size(F.filter("ends", lambda e: e <= r)))
    out = d.select("doc_id", "source", "size", "source_size", "target", F.size("drawn").alias("copies"), (F.col("size") * F.size("drawn")).alias("taken"), shards.alias("shards"))
    return scratch.finish(out, "sizes", "draws", "parts")


def shard_rows(mixed: DataFrame, docs: DataFrame, columns: Sequence[str], seed: int = 17, run_words: int = RUN_WORDS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mix itself: the named columns of docs, a row for each copy, with its shard, run and place in the run.

    `mixed` is what `mix` made of the same docs with the same seed. Rows find their copies by id and source, nulls
    being equal to each other, so rows that repeat an id are as many rows for each copy and not their square. A null text has
    a row like any other, as often as it was drawn. The parts of a shard's blocks are dealt to as many runs as make
    run_words of the mix each, so no task needs a whole shard or a whole block; a very long text is in one run. Places
    follow a seeded hash: the same tables give the same places, but for equal rows, which may have each other's. An
    empty table gives no rows. Other columns of docs may have any name; `columns` may not hold shard, run or place.
    """
    if clash := {"shard", "run", "place"} & set(columns):
        raise ValueError(f"columns of the result: {sorted(clash)}")
    n = mixed.select(F.sum("taken").alias("words"), F.max(F.array_max("shards")).alias("last")).first()
    n_runs = max(1, -(-(n.words or 0) // (run_words * ((n.last or 0) + 1))))
    copies = mixed.groupBy(F.col("doc_id").alias("id_"), F.col("source").alias("source_")).agg(F.first("shards").alias("shards"))
    rows = docs.select(F.struct(*columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"))
    rows = rows.join(growing(copies), F.col("id").eqNullSafe(F.col("id_")) & F.col("source").eqNullSafe(F.col("source_")))
    rows = rows.select("row", "source", F.xxhash64(F.lit(seed), "source", "id").alias("h"), F.posexplode("shards").alias("copy", "shard"))
    # the first twenty bits are the block and the part of it that mix drew
    run = F.pmod(F.xxhash64(F.lit(seed), "source", "shard", F.shiftrightunsigned("h", 44)), F.lit(n_runs)).cast("int").alias("run")
    rows = rows.select("row", "shard", run, F.xxhash64(F.lit(seed + 1), "h", "copy", F.to_json("row")).alias("order"))
    place = F.row_number().over(W.partitionBy("shard", "run").orderBy("order")) - 1
    return rows.withColumn("place", place.cast("long")).select("row.*", "shard", "run", "place")


def write_shards(mixed: DataFrame, docs: DataFrame, path: str, columns: Sequence[str], **options) -> None:
    """`shard_rows` as Parquet: a folder for each shard, in it one for each run, rows in the order of their places."""
    rows = shard_rows(mixed, docs, columns, **options)
    rows.sortWithinPartitions("shard", "run", "place").write.mode("overwrite").partitionBy("shard", "run").parquet(path)
