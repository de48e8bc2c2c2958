"""Embedding near-dedup: an exact metric range join over pivot cells, boundaries replicated by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, components, growing

#: A label with n different vectors has sqrt(n) / PIVOT_STEP pivots, if those are CELL_ROWS vectors to a pivot or more.
#: That number is raised with the input so that all pivots together have at most 2 * PIVOT_BYTES.
PIVOT_STEP, CELL_ROWS, PIVOT_BYTES = 4, 16, 64 << 20
#: Rows of a block's side; a cell with more of its own is cut into rings around its pivot, and rings into blocks.
BLOCK_ROWS = 2048
#: A vector with HOT_ROWS copies and this share of all rows, or more, is looked up by broadcast.
HOT_ROWS, HOT_SHARE = 2048, 1 / 1024
#: Room for rounding in distances, which a root of a small difference makes large; it only replicates more.
ROUND = 1e-6

ROWS = "vec_id long, label string, unit binary"
HOMED = "uid long, rep long, m long, label string, unit binary, home int, d double"
DEALT = "uid long, rep long, m long, unit binary, cell string, kind int, d double"


def _units(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        units = []
        for v in batch.column(2):
            x = v.as_py()
            x = None if not x or any(c is None for c in x) else np.array(x, "<f8")
            if x is not None:
                scale = np.abs(x).max()
                x = x / scale if np.isfinite(scale) and scale > 0 else None
            units.append(None if x is None else (x / np.sqrt(x @ x)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary())], names=["vec_id", "label", "unit"])


def _stack(units):
    import numpy as np

    return np.frombuffer(b"".join(units), "<f8").reshape(len(units), -1)


def _distances(units, pivots):
    import numpy as np

    return np.sqrt(np.maximum(0, 2 - 2 * (_stack(units) @ pivots.T)))


def _home(pivots):
    """The nearest pivot of each vector and its distance; pivot 0 where its label has none."""

    def run(frames: Iterator) -> Iterator:
        for pdf in frames:
            pdf["home"], pdf["d"] = 0, 0.0
            for (label, n), part in pdf.groupby(["label", pdf["unit"].map(len)]):
                if (label, n) in pivots.value:
                    d = _distances(part["unit"], _stack(pivots.value[label, n]))
                    pdf.loc[part.index, "home"], pdf.loc[part.index, "d"] = d.argmin(1), d.min(1)
            yield pdf

    return run


def _deal(pivots, radii, reach: float):
    """Each vector in its home cell, and a copy of it in every later cell that may hold a vector within reach."""

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in frames:
            size = pdf["unit"].map(len)
            stem = size.astype(str) + "|" + pdf["label"] + "|"
            base = pdf[["uid", "rep", "m", "unit"]]
            yield base.assign(cell=stem + pdf["home"].astype(str), kind=0, d=pdf["d"])
            for (label, n), part in pdf.groupby(["label", size]):
                if (label, n) not in pivots.value:
                    continue
                d = _distances(part["unit"], _stack(pivots.value[label, n]))
                home = part["home"].to_numpy()
                # a partner y at home in q has d(y,q) <= d(y,home), so d(x,q) - d(x,home) <= 2 * reach,
                # and d(y,q) is at most the radius of q, so d(x,q) <= radius + reach
                near = d <= part["d"].to_numpy()[:, None] + 2 * reach + ROUND
                near &= (d <= radii.value[label, n] + reach + ROUND) & (np.arange(d.shape[1]) > home[:, None])
                rows, cells = np.nonzero(near)
                if len(rows):
                    copies = base.loc[part.index].iloc[rows]
                    yield copies.assign(cell=pd.Series([f"{n}|{label}|{q}" for q in cells], index=copies.index), kind=1, d=d[rows, cells])

    return run


def _join(least: float):
    """One block: how many rows each vector of it links to, and links that span the block's parts."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        left, right = pdf[pdf["side"] != 1], pdf[pdf["side"] != 0]  # side 2 is both, in a block of one chunk
        none = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("uid", "rep", "n", "root")})
        if left.empty or right.empty:
            return none
        near = _stack(left["unit"]) @ _stack(right["unit"]).T >= least
        near &= left["uid"].to_numpy()[:, None] != right["uid"].to_numpy()[None, :]
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(rows):
            return none
        left, right, near = left.iloc[rows], right.iloc[cols], near[np.ix_(rows, cols)]
        one = bool((pdf["side"] == 2).any())
        to_right, to_left = near @ right["m"].to_numpy(), left["m"].to_numpy() @ near
        x, y, far = left["rep"].to_numpy().copy(), right["rep"].to_numpy().copy(), np.iinfo(np.int64).max
        while True:  # the least id of each part of the block, by turns over both sides
            y2 = np.minimum(y, np.where(near, x[:, None], far).min(0))
            x2 = np.minimum(x, np.where(near, y2[None, :], far).min(1))
            if (x2 == x).all() and (y2 == y).all():
                break
            x, y = x2, y2
        ends = [left[["uid", "rep"]].assign(n=to_right, root=x)]
        if not one:
            ends.append(right[["uid", "rep"]].assign(n=to_left, root=y))
        return pd.concat(ends)

    return run


def _pivots(different: DataFrame) -> dict[tuple[str, int], list[bytes]]:
    """Pivots of every label and length: the different vectors with the least hash of their slot."""
    size = F.length("unit").alias("size")
    sizes = different.groupBy("label", size).agg(F.count("*").alias("n"))
    rows = max(CELL_ROWS, (different.agg(F.sum(F.length("unit")).alias("b")).first().b or 0) // PIVOT_BYTES)
    wanted = F.ceil(F.least(F.col("n") / rows, F.sqrt("n") / PIVOT_STEP)).cast("int").alias("wanted")
    slots = different.select("label", size, "unit", "uid").join(sizes.where(F.col("n") > rows).select("label", "size", wanted), ["label", "size"])
    slots = slots.groupBy("label", "size", F.pmod(F.xxhash64(F.lit(3), "uid"), "wanted").alias("slot")).agg(F.min_by("unit", F.xxhash64(F.lit(4), "uid")).alias("unit"))
    found: dict[tuple[str, int], list[bytes]] = {}
    for r in slots.select("label", "size", "unit").orderBy("label", "size", "unit").collect():  # 2 * PIVOT_BYTES at most
        found.setdefault((r.label, r.size), []).append(bytes(r.unit))
    return found


def _radii(homed: DataFrame, pivots: dict) -> dict:
    """Largest distance of each cell's own vectors to its pivot."""
    import numpy as np

    radii = {key: np.zeros(len(units)) for key, units in pivots.items()}
    ends = homed.where("d > 0").groupBy("label", F.length("unit").alias("size"), "home").agg(F.max("d").alias("radius"))
    for r in ends.collect():  # a row for each pivot at most: the vectors of other labels have d = 0
        radii[r.label, r.size][r.home] = r.radius
    return radii


def _chunks(dealt: DataFrame, reach: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """dealt with the chunk of each row, and for each chunk the blocks (a, b) that it is a side of."""
    rows = dealt.withColumn("fine", F.floor(F.col("d") / ((reach + ROUND) / 2)).cast("int"))
    rings = rows.groupBy("cell", "kind", "fine").agg(F.count("*").alias("n"))
    whole = F.sum(F.expr("if(kind = 0, n, 0)")).over(W.partitionBy("cell")) <= BLOCK_ROWS  # one chunk of own vectors meets all copies
    rings = rings.withColumn("ring", F.when(whole, 0).otherwise(F.col("fine")))
    parts = F.ceil(F.sum("n").over(W.partitionBy("cell", "kind", "ring")) / BLOCK_ROWS).cast("int")
    rings = scratch.save(rings.withColumn("parts", parts).drop("n"), "rings")
    rows = rows.join(growing(rings), ["cell", "kind", "fine"])
    chunk = F.struct("kind", "ring", F.pmod(F.xxhash64("uid"), "parts").cast("int").alias("part"))
    rows = rows.select("uid", "rep", "m", "unit", "cell", chunk.alias("chunk"))
    chunks = rings.select("cell", "kind", "ring", "parts").distinct()
    chunks = chunks.select("cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct("kind", "ring", p.alias("part")))).alias("chunk"))
    # distances are to the cell's one pivot, so linked vectors lie in rings that differ by two at most
    a, b = chunks.where("chunk.kind = 0").withColumnRenamed("chunk", "a"), chunks.withColumnRenamed("chunk", "b")
    blocks = scratch.save(a.join(growing(b), "cell").where("b >= a and abs(a.ring - b.ring) <= 2"), "blocks")
    sides = blocks.select("cell", F.col("a").alias("chunk"), "a", "b", F.expr("if(a = b, 2, 0)").alias("side"))
    return rows, sides.unionByName(blocks.where("a <> b").select("cell", F.col("b").alias("chunk"), "a", "b", F.lit(1).alias("side")))


def link_embeddings(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of one label with cosine >= least in double precision, exactly.

    Returns one row a vector: vec_id, n_links (other vectors linked to it directly), component_id (the least
    vec_id reachable, itself included), kept (vec_id = component_id). Vectors that are null, empty, zero or hold
    a null or a non-finite number, and vectors with a null label, link with nothing; so do vectors of different
    lengths. Rows that repeat an id are vectors of their own: links between them count, and each shows the links
    of all and their one component. A row with a null id links with nothing and has a null component and kept. An empty table
    gives no rows.

    Equal vectors of a label are one vector with a weight, so a group of copies costs one row however large.
    Chord distance of unit vectors is a metric, and cosine >= c is distance <= sqrt(2 - 2c). The pivots of a
    label grow with the root of its different vectors, at every size, and are chosen by hashes, so dense regions
    have more of them; PIVOT_BYTES bounds what is broadcast. A vector is at home with its nearest pivot and copied
    to the later cells that the triangle inequality leaves possible, by its own distances and by the radius of the
    cell; each pair meets once and counts for both. A cell with more
    than BLOCK_ROWS of its own is cut into rings of half the reach around its pivot, rings into chunks, and only chunks of rings
    that can hold a link meet, as tasks of their own. A block returns a row for each linked vector, never its pairs.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embed")
    try:
        out = _link(vectors, least, id_col, vector_col, label_col, scratch)
        return scratch.save(out, "result")
    finally:
        scratch.drop_but("result")


def _link(vectors: DataFrame, least: float, id_col: str, vector_col: str, label_col: str, scratch: Scratch) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    rows = scratch.save(rows.mapInArrow(_units, ROWS).withColumn("digest", F.unhex(F.sha2("unit", 256))), "units")
    good = rows.where("vec_id is not null and unit is not null and label is not null")
    different = good.groupBy("label", "digest").agg(F.first("unit").alias("unit"), F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    different = scratch.save(different.withColumn("uid", F.monotonically_increasing_id()), "different")
    pivots = _pivots(different)
    shared, reach = spark.sparkContext.broadcast(pivots), max(0.0, 2 - 2 * least) ** 0.5
    homed = scratch.save(different.select("uid", "rep", "m", "label", "unit").mapInPandas(_home(shared), HOMED), "homed")
    radii = spark.sparkContext.broadcast(_radii(homed, pivots))
    dealt = scratch.save(homed.mapInPandas(_deal(shared, radii, reach), DEALT), "dealt")
    chunked, sides = _chunks(dealt, reach, scratch)
    found = chunked.join(growing(sides), ["cell", "chunk"]).groupBy("cell", "a", "b").applyInPandas(_join(least), "uid long, rep long, n long, root long")
    found = scratch.save(found, "found")
    linked = different.join(found.groupBy("uid").agg(F.sum("n").alias("n")), "uid", "left")
    linked = scratch.save(linked.select("label", "digest", "rep", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n")).where("n > 0"), "linked")
    # at most 1 / HOT_SHARE vectors are that share of all rows
    least_hot = max(HOT_ROWS, (linked.agg(F.sum("m").alias("n")).first().n or 0) * HOT_SHARE)
    slim, key = good.select("vec_id", "label", "digest"), ["label", "digest"]
    hot = F.broadcast(linked.where(F.col("m") >= least_hot).drop("m"))
    rest = slim.join(hot, key, "left_anti").join(growing(linked.where(F.col("m") < least_hot).drop("m")), key)
    each = scratch.save(slim.join(hot, key).unionByName(rest), "each")
    links = each.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(each.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    parts = components(edges, scratch)
    out = rows.select("vec_id").join(links, "vec_id", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
