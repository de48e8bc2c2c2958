"""MinHash near-dedup with an LSH forest: sorted signature orders, neighbours by common prefix, depth by region."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, growing
from .shingles import Shingler, signature

#: Signature orders, hashes in each, and the prefix that makes a region.
TREES, DEPTH, BASE = 20, 8, 4
#: Texts of a region that are compared with each other by signature; larger regions are cut at the next depth.
REGION = 48
#: Texts of a block: what is still apart in a larger region is compared block by block. Parts of over a quarter of it have
#: blocks of their own.
BLOCK = 512
#: Similarities estimated from TREES * DEPTH hashes: pairs this far below the threshold aren't looked at, and pairs this
#: far above it are chained, not paired. The estimate's deviation is under 0.035.
BELOW, ABOVE = 0.15, 0.06
#: Texts that one task compares with a leader.
MEMBERS = 2000


def _sign(size: int):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        shingle = Shingler(size)
        for batch in batches:
            n, digests, signs = [], [], []
            for text in batch.column(1):
                s = shingle(text.as_py())
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signs.append(signature(s, TREES * DEPTH).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "digest", "sign"])

    return run


def _compare(size: int, percent: int):
    """Rows of one leader, its own first: the members whose sets are near enough."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingle, leader, own = Shingler(size), None, None
        for batch in batches:
            a, b = [], []
            for lead, node, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                s = shingle(text.as_py())
                if node == lead:
                    leader, own = lead, s
                elif lead == leader:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        a.append(lead)
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (leader, node) whose full sets are near enough. A leader's members are dealt to tasks of about MEMBERS."""
    spread = pairs.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("n_parts"))
    members = pairs.join(growing(spread), "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("n_parts")).cast("int").alias("part"), "node")
    own = spread.select("leader", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), F.col("leader").alias("node"))
    rows = members.unionByName(own).join(growing(texts), "node").select("leader", "part", "node", "text")
    rows = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("node") != F.col("leader"))
    return rows.mapInArrow(_compare(size, percent), "a long, b long")


def _shorten(batches: Iterator) -> Iterator:
    """One byte of each hash of a signature, enough to estimate by."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        signs = [np.frombuffer(x, "<u4").astype(np.uint8).tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs, pa.binary())], names=["node", "s"])


def _near(least: float, chained: float, again: bool):
    """Rows in order of region, to pairs of its texts whose signatures agree enough.

    The first time, texts that agree very well are chained by a spanning forest, and further pairs are only made
    between its parts. Again, `part` says what is linked by now, and all near pairs of different parts are made.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: list[tuple] = []

        def pairs():
            nodes = np.array([h[1] for h in held])
            order = np.argsort(nodes)
            signs = np.frombuffer(b"".join(held[k][2] for k in order), np.uint8).reshape(len(held), -1)
            nodes, parts = nodes[order], [held[k][3] for k in order]
            out = []
            like = np.stack([(signs == s).mean(1) for s in signs])
            if again:
                parts = np.array(parts)
                near = np.argwhere(np.triu((like >= least) & (parts[:, None] != parts[None, :])))
            else:
                root = np.arange(len(nodes))
                for a, b in np.argwhere(np.triu(like >= chained, 1)):
                    if root[a] != root[b]:
                        root[root == root[b]] = root[a]
                        out.append((a, b))
                near = np.argwhere(np.triu((like >= least) & (root[:, None] != root[None, :]), 1))
            return [(int(nodes[a]), int(nodes[b])) for a, b in [*out, *near]]

        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    found += pairs() if len(held) > 1 else []
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["leader", "node"])
        if len(held) > 1:
            found = pairs()
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["leader", "node"])

    return run


def _apart(size: int, percent: int, confirm: bool):
    """Rows (cell, block, node, part, s, text) in order of cell: pairs of different parts, between the cell's two blocks
    or within its only one, whose signatures agree enough.

    To begin with, (cell, node) of the texts in such pairs. With `confirm`, the pairs (a, b) whose full sets are near
    enough, likeliest first, but those of parts that the cell has linked by then.
    """
    least = percent / 100 - BELOW

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingle = Shingler(size)
        names = ["a", "b"] if confirm else ["cell", "node"]
        held: list[tuple] = []

        def common(sets, left, right):
            """Sizes of all intersections, by products of 0-1 matrices over the shingles of more than one text."""
            _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row, shared = np.repeat(np.arange(len(sets)), list(map(len, sets))), count > 1
            row, column = row[shared[place]], (np.cumsum(shared) - 1)[place[shared[place]]]
            order = np.argsort(column, kind="stable")
            row, column, out = row[order], column[order], np.zeros((len(left), len(right)), np.int64)
            for k in range(0, int(shared.sum()), 2048):
                lo, hi = np.searchsorted(column, [k, k + 2048])
                x = np.zeros((len(sets), 2048), np.float32)
                x[row[lo:hi], column[lo:hi] - k] = 1
                out += (x[left] @ x[right].T).astype(np.int64)
            return out

        def found():
            of = np.array([h[1] for h in held])
            parts = np.array([h[3] for h in held])
            signs = np.frombuffer(b"".join(h[4] for h in held), np.uint8).reshape(len(held), -1)
            left = np.flatnonzero(of == of[0])
            right = np.flatnonzero(of != of[0])
            alone = not len(right)
            right = left if alone else right
            some: list = [[], [], []]
            for i in left:
                like = (signs[right] == signs[i]).mean(1)
                near = np.flatnonzero((like >= least) & (parts[right] != parts[i]) & (not alone or right > i))
                for column, values in zip(some, (np.full(len(near), i), right[near], like[near])):
                    column.append(values)
            a, b, like = map(np.concatenate, some)
            if not confirm:
                return [(held[0][0], held[k][2]) for k in np.unique(np.concatenate([a, b]))]
            root, out = np.unique(parts, return_inverse=True)[1], []
            i, j = np.searchsorted(left, a), np.searchsorted(right, b)
            sets = [shingle(h[5]) for h in held]
            n, both = np.array(list(map(len, sets))), common(sets, left, right)[i, j]
            sure = np.flatnonzero(100 * both >= percent * (n[a] + n[b] - both))
            for k in sure[np.argsort(-like[sure], kind="stable")]:
                if root[a[k]] != root[b[k]]:
                    root[root == root[b[k]]] = root[a[k]]
                    out.append((held[a[k]][2], held[b[k]][2]))
            return out

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([int(r[k]) for r in rows], pa.int64()) for k in (0, 1)], names=names)

        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    rows += found()
                    held = []
                held.append(row)
            yield batch_of(rows)
        if held:
            yield batch_of(found())

    return run


def _across(large: DataFrame, parts: DataFrame, short: DataFrame, rows: DataFrame, size: int, percent: int, whole: bool, scratch: Scratch) -> tuple[DataFrame | None, int]:
    """Confirmed links (a, b) between the parts of regions over REGION, and their number.

    A region's texts lie in blocks of about BLOCK: those of a large part in blocks of their own, all others by their
    part. Cells are pairs of blocks but those of one part; unless `whole`, only a block with itself and with the
    region's first. Texts are only read where signatures agree.
    """
    tag = f"across-{int(whole)}"
    labelled = large.join(growing(parts), "node", "left").select("region", "node", F.coalesce("component", "node").alias("part"))
    labelled = scratch.save(labelled, f"{tag}-parts")
    sizes = scratch.save(labelled.groupBy("region", "part").agg(F.count("*").alias("n")), f"{tag}-sizes")
    small = F.col("n") <= BLOCK // 4
    split = sizes.groupBy("region").agg(F.count("*").alias("k"), F.sum(F.when(small, F.col("n"))).alias("m")).where("k > 1").drop("k")
    split, n_split, _ = scratch.save_counted(split, f"{tag}-split")
    made = [f"{tag}-parts", f"{tag}-sizes", f"{tag}-split"]
    if not n_split:
        scratch.drop(*made)
        return None, 0
    sizes = scratch.save(sizes.join(growing(split), "region"), f"{tag}-dealt")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK)
    block = F.when(small, F.xxhash64("region", F.pmod(F.xxhash64(F.lit(3), "part"), blocks("m")))).otherwise(F.xxhash64("region", F.lit(1), "part", F.pmod(F.xxhash64(F.lit(5), "node"), blocks("n"))))
    dealt = labelled.join(growing(sizes), ["region", "part"]).select("region", "node", "part", block.alias("block"), F.when(~small, F.col("part")).alias("owner"))
    dealt = scratch.save(dealt.join(growing(short), "node"), f"{tag}-blocks")
    each = scratch.save(dealt.groupBy("region", "block").agg(F.first("owner").alias("owner")), f"{tag}-each")
    other = each.select("region", F.col("block").alias("b"), F.col("owner").alias("o"))
    if not whole:
        other = other.groupBy("region").agg(F.min(F.struct("b", "o")).alias("x")).select("region", "x.*")
    # a block's own rows are a cell where they may be of different parts
    pairs = each.join(growing(other), "region").where(F.when(F.lit(whole), F.col("block") < F.col("b")).otherwise(F.col("block") != F.col("b")) & ~F.coalesce(F.col("owner") == F.col("o"), F.lit(False)))
    pairs = pairs.select("block", "b").unionByName(each.where("owner is null").select("block", F.col("block").alias("b")))
    cells = pairs.select(F.xxhash64("block", "b").alias("cell"), F.explode(F.array_distinct(F.array("block", "b"))).alias("block"))
    cells = scratch.save(cells, f"{tag}-cells")
    placed = dealt.join(growing(cells), "block").select("cell", "block", "node", "part", "s")
    in_cells = lambda d: d.repartition("cell").sortWithinPartitions("cell", "block", "node")
    near = in_cells(placed).mapInArrow(_apart(size, percent, False), "cell long, node long")
    near, n_near, _ = scratch.save_counted(near, f"{tag}-near")
    made += [f"{tag}-{x}" for x in ("dealt", "blocks", "each", "cells", "near")]
    links, n_links = None, 0
    if n_near:
        wanted = near.select(F.col("node").alias("doc_id")).distinct()
        texts = rows.join(growing(wanted), "doc_id").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "text")
        texts = scratch.save(texts, f"{tag}-texts")
        held = placed.join(growing(near), ["cell", "node"]).join(growing(texts), "node").select("cell", "block", "node", "part", "s", "text")
        links, n_links, _ = scratch.save_counted(in_cells(held).mapInArrow(_apart(size, percent, True), "a long, b long").distinct(), f"{tag}-links")
        made.append(f"{tag}-texts")
    scratch.drop(*made)
    return links, n_links


FOREST = "kind int, region long, node long, leader long"
#: What a row of the forest's table says: a member of a region, a leader of a large run, a member of a region that was large.
MEMBER, STAR, LARGE = range(3)


def _runs(batches: Iterator) -> Iterator:
    """Rows (tree, order, node) in sorted order to regions: runs of neighbours by their longest common prefixes.

    A run of two to REGION nodes with BASE hashes in common is a region; a larger one is held against its leader and parted
    where the common prefixes are shorter by one hash, down to DEPTH, where nodes with equal orders go on in stretches. A
    run at either end of the rows may go on in the next part of the order: its rows are given as a region, which meets its
    other half by name, and as rows of a large one.
    """
    import numpy as np
    import pyarrow as pa

    from .shingles import PLACES, mix

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    tree = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
    order = np.frombuffer(b"".join(x for b in held for x in b.column(1).to_pylist()), "<u4").reshape(len(tree), DEPTH)
    node = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in held])
    common = np.cumprod((order[1:] == order[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(1)
    name = tree.astype(np.uint64) + np.uint64(1)
    names = []  # of the prefix of each depth
    for k in range(DEPTH):
        name = mix(name * np.uint64(PLACES[0]) + order[:, k].astype(np.uint64) * np.uint64(PLACES[1]) + np.uint64(k))
        names.append(name.view(np.int64))
    out: list[list] = [[], [], [], []]

    def put(kind, region, nodes, leader=None):
        for column, x in zip(out, (np.full(len(nodes), kind), region, nodes, nodes if leader is None else leader)):
            column.append(x)

    active = np.ones(len(tree), bool)
    for depth in range(BASE, DEPTH + 1):
        run = np.concatenate([[0], np.cumsum(common < depth)])
        n = np.bincount(run)[run]
        region = names[depth - 1]
        edge = (run == 0) | (run == run[-1]) if depth == BASE else np.zeros(len(run), bool)
        small = active & ((n > 1) | edge) & (n <= REGION)
        put(MEMBER, region[small], node[small])
        put(LARGE, region[edge & (n <= REGION)], node[edge & (n <= REGION)])
        active &= n > REGION
        if depth == BASE:
            put(LARGE, region[active], node[active])
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        least = np.minimum.reduceat(node, starts)[run]
        star = active & (node != least)
        put(STAR, region[star], node[star], least[star])
    place = np.arange(len(run)) - starts[run]
    region = mix(names[-1].view(np.uint64) * np.uint64(PLACES[2]) + (place // (REGION // 2)).astype(np.uint64)).view(np.int64)
    put(MEMBER, region[active], node[active])
    columns = [np.concatenate(c) for c in out]
    for k in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000], t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["kind", "region", "node", "leader"])


def _forest(reps: DataFrame) -> DataFrame:
    """The runs of all sorted orders: one shuffle by ranges, which cut a run of a third of all nodes to many tasks."""
    width = DEPTH * 4
    orders = F.array(*[F.substring("sign", 1 + t * width, width) for t in range(TREES)])
    n_parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = reps.select(F.posexplode(orders).alias("tree", "order"), "node")
    return rows.repartitionByRange(n_parts, "tree", "order", "node").sortWithinPartitions("tree", "order", "node").mapInArrow(_runs, FOREST)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose sets of word shingles have a Jaccard similarity of at least percent / 100.

    Returns one row for each input row: doc_id, n_shingles, component_id (the least id reachable by links), kept
    (doc_id = component_id). Null, empty and blank texts have no shingles and stand alone. A row with a null id
    gets its n_shingles, a null component, and is kept. Rows of one id are one document. Texts are taken whole, however
    long; an empty table gives no rows.

    Documents with equal sets are one node. In each of TREES sorted signature orders, neighbours whose longest common
    prefixes have BASE hashes or more make a region; a region of more than REGION nodes is held against its leader (its
    least node, so that the orders agree on it and a large group gives a few pairs a text) and parted where the common
    prefixes are shorter, as deep as that region needs. Within regions, pairs are chosen by their whole signatures, confirmed on the full sets, and what is still apart
    afterwards is paired once more. Last, what is still apart in a region that was too large at BASE is compared in
    pairs of blocks, so every two texts that share a prefix of BASE hashes are compared or linked; no region, bucket
    or candidate list is capped. What is missed: two texts at a similarity of 0.85 share no prefix with probability
    (1 - 0.85^4)^20, under 1e-6; at 0.8, under 3e-5; at 0.7, 0.4 %; at 0.5, 28 %. A pair is also missed where its
    estimate is BELOW under the threshold, 4 deviations off or more.
    """
    scratch, least = Scratch(docs.sparkSession, "minhash"), percent / 100
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.save(rows.mapInArrow(_sign(size), "doc_id long, n_shingles long, digest binary, sign binary"), "signed")
    some = signed.where("doc_id is not null and digest is not null")
    reps = some.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("sign").alias("sign"))
    reps = scratch.save(reps, "reps")
    forest = scratch.save(_forest(reps.select("node", "sign")), "forest")
    stars = forest.where(F.col("kind") == STAR).select("leader", "node").distinct()
    large = forest.where(F.col("kind") == LARGE).select("region", "node").distinct()
    short = reps.select("node", "sign").mapInArrow(_shorten, "node long, s binary")
    members = forest.where(F.col("kind") == MEMBER).select("region", "node").distinct()
    regions = scratch.save(members.join(growing(short), "node"), "regions")
    by_region = lambda d: d.repartition("region").sortWithinPartitions("region", "node")
    pairs = "leader long, node long"
    flat = by_region(regions.select("region", "node", "s", F.lit(0).cast("long").alias("part")))
    asked = stars.unionByName(flat.mapInArrow(_near(least - BELOW, least + ABOVE, False), pairs)).distinct()
    asked = scratch.save(asked, "asked")
    wanted = asked.select(F.col("node").alias("doc_id")).union(asked.select("leader")).distinct()
    texts = scratch.save(rows.join(growing(wanted), "doc_id").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "text"), "texts")
    links = scratch.save(_confirm(asked, texts, size, percent), "links")
    parts = scratch.save(components(links, scratch), "parts")
    labelled = regions.join(growing(parts), "node", "left").select("region", "node", "s", F.coalesce("component", "node").alias("part"))
    split = labelled.groupBy("region").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("region")
    more = by_region(labelled.join(growing(split), "region")).mapInArrow(_near(least - BELOW, 2.0, True), pairs)
    more, n_more, _ = scratch.save_counted(more.distinct().join(asked, ["leader", "node"], "left_anti"), "more")
    if n_more:
        more_links, n_links, _ = scratch.save_counted(_confirm(more, texts, size, percent), "more-links")
        if n_links:
            links = links.unionByName(more_links)
            parts = scratch.save(components(links, scratch), "all-parts")
    for whole in (False, True):  # first a few cells, which link what is dense
        far_links, n_far = _across(large, parts, short, rows, size, percent, whole, scratch)
        if n_far:
            links = links.unionByName(far_links)
            parts = scratch.save(components(links, scratch), f"parts-{int(whole)}")
    parts = parts.withColumnRenamed("component", "part")
    out = signed.select("doc_id", "n_shingles", "digest").join(growing(reps.select("digest", "node")), "digest", "left").join(growing(parts), "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("part", "node", "doc_id").alias("c"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("c"))
    return scratch.finish(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == F.col("c"), F.lit(True)).alias("kept")), "signed", "texts", "regions", "reps", "asked", "forest", "links", "parts", "more", "more-links", "all-parts", "across-0-links", "across-1-links", "parts-0", "parts-1")
