"""Removal of long repeated strings: shards of suffixes, each sorted by induction, found by sampled anchors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, growing
from .induced_sort import suffix_array
from .shingles import mix

#: Bytes of the strings that are removed, where the caller doesn't say.
LENGTH = 400
#: Text of a block of documents, and of a shard of suffixes.
BLOCK_BYTES, SHARD_BYTES = 12_000_000, 2_000_000
#: Distinct stretches of one anchor that are sorted together; more are told apart by longer contexts first.
CROWD = 256
#: Starts of one stretch of a text; a place in it fits the low bits of a sampled hash.
STRETCH_BITS = 20

BLOCK = "block long, data binary"
OWNED = "block long, doc int, lo long, hi long, anchor long, c1 long, c2 long"
PART = "anchor long, c1 long, c2 long, at int, key long, d1 long, d2 long, data binary"
FOUND = "anchor long, c1 long, c2 long, runs array<int>"


def _blocks(batches: Iterator) -> Iterator:
    import pickle

    import pyarrow as pa
    from pyspark import TaskContext

    n, rows, size = TaskContext.get().partitionId() << 32, [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([pa.compress(pickle.dumps(rows), codec="zstd", asbytes=True)], pa.binary())], names=["block", "data"])

    for batch in batches:
        for doc_id, text, *others in zip(batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:])):
            text = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if rows and size + len(text) > BLOCK_BYTES:
                yield flush()
                n, rows, size = n + 1, [], 0
            rows.append((doc_id, text, *others))
            size += len(text) + 64
    if rows:
        yield flush()


def _open(data) -> list[tuple]:
    """(id, text as bytes, carried columns...) of a block's documents."""
    import pickle

    import pyarrow as pa

    return pickle.loads(pa.input_stream(pa.BufferReader(data), compression="zstd").read())


def two_to(most: int) -> int:
    """The largest power of two that isn't larger."""
    return 1 << most.bit_length() - 1


def anchor_bytes(length: int) -> int:
    """Bytes of the anchors that bring equal strings of this length together."""
    return two_to(max(1, length // 6))


def _rolling(text, width: int):
    """A 64-bit polynomial hash of each run of `width` bytes, a power of two, by doubling."""
    import numpy as np

    h, base, k = text.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while k < width:
        h = h[:-k] * np.uint64(base) + h[k:]
        base, k = base * base & 0xFFFFFFFFFFFFFFFF, 2 * k
    return h


def _anchors(text, length: int):
    """The anchor of each string of `length` bytes (the run of anchor_bytes in it with the least hash, the first of equals),
    as the starts [lo, hi] it owns and its hash. Equal strings have equal anchors at equal places in them."""
    import numpy as np

    anchor = anchor_bytes(length)
    span = length - anchor + 1
    n_starts, low = len(text) - length + 1, np.uint64((1 << STRETCH_BITS + 1) - 1)
    lo, hi, hashes = [], [], []
    for first in range(0, n_starts, 1 << STRETCH_BITS):
        last = min(first + (1 << STRETCH_BITS), n_starts)
        h = mix(_rolling(text[first : last + length - 1], anchor))
        padded = np.full(-(-len(h) // span) * span, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(h)] = h & ~low | np.arange(len(h), dtype=np.uint64)
        rows = padded.reshape(-1, span)
        onward = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(back[: last - first], onward[span - 1 : span - 1 + last - first]) & low).astype(np.int64)
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        lo.append(first + cuts)
        hi.append(first + np.append(cuts[1:], last - first) - 1)
        hashes.append(h[at[cuts]])
    return np.concatenate(lo), np.concatenate(hi), np.concatenate(hashes).view(np.int64)


def _owned(length: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts: list[list] = [[], [], [], [], []]
                for k, (_, text, *_others) in enumerate(_open(data.as_py())):
                    if len(text) >= length:
                        lo, hi, anchor = _anchors(np.frombuffer(text, np.uint8), length)
                        content = b"".join([xxhash.xxh3_128_digest(text[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist())])
                        for column, x in zip(parts, (np.full(len(lo), k), lo, hi, anchor, np.frombuffer(content, np.int64))):
                            column.append(x)
                if parts[0]:
                    doc, lo, hi, anchor, content = map(np.concatenate, parts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), block)), pa.array(doc, pa.int32()), pa.array(lo), pa.array(hi), pa.array(anchor), pa.array(content[::2].copy()), pa.array(content[1::2].copy())], names=["block", "doc", "lo", "hi", "anchor", "c1", "c2"])

    return run


def _fetch(length: int):
    """Bytes of the wanted stretches of one block."""

    def run(blocks, wanted):
        import pandas as pd

        if blocks.empty or wanted.empty:
            return pd.DataFrame({"anchor": [], "c1": [], "c2": [], "k": [], "data": []}, dtype=object).astype({"anchor": "int64", "c1": "int64", "c2": "int64", "k": "int64"})
        docs = _open(blocks["data"].iloc[0])
        wanted["data"] = [docs[d][1][a : b + length] for d, a, b in zip(wanted["doc"], wanted["lo"], wanted["hi"])]
        return wanted[["anchor", "c1", "c2", "k", "data"]]

    return run


def _split(length: int, width: int):
    """Stretches cut where a string's distance to its anchor is a multiple of `width`. The key of a part is a hash of the
    bytes that all strings at its distances hold, so equal strings have parts of equal keys."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        low = np.uint64((1 << STRETCH_BITS + 1) - 1)
        for batch in batches:
            parts: list[list] = [[] for _ in range(6)]
            content = []
            for anchor, c1, c2, first, data in zip(*(c.to_pylist() for c in batch.columns)):
                place = int(np.argmin(mix(_rolling(np.frombuffer(data, np.uint8, length), anchor_bytes(length))) & ~low))
                last = len(data) - length
                for q in range((place - last) // width, place // width + 1):
                    near, far = q * width, (q + 1) * width - 1
                    a, b = max(0, place - far), min(last, place - near)
                    key = xxhash.xxh3_64_digest(data[place - near : place - far + length], seed=q)
                    some = data[a : b + length]
                    for column, x in zip(parts, (anchor, c1, c2, first + a, key, some)):
                        column.append(x)
                    content.append(xxhash.xxh3_128_digest(some))
            if content:
                d = np.frombuffer(b"".join(content), np.int64)
                ids, at, key = map(pa.array, parts[:3]), pa.array(parts[3], pa.int32()), pa.array(np.frombuffer(b"".join(parts[4]), np.int64))
                yield pa.RecordBatch.from_arrays([*ids, at, key, pa.array(d[::2].copy()), pa.array(d[1::2].copy()), pa.array(parts[5], pa.binary())], names=["anchor", "c1", "c2", "at", "key", "d1", "d2", "data"])

    return run


def _by_context(data: DataFrame, length: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """Stretches to sort (anchor, c1, c2, at, key, data), CROWD of a key at most; runs that counts settle; tables written.

    The stretches of a crowded anchor are cut into parts that share more bytes (_split). A part alone with its key has
    no repeat, a part that occurs twice is a repeat whole, and the distinct parts of one key are sorted or, if they are
    a crowd, cut again, until a part is one string and its key a hash of all of it.
    """
    here = data.select("anchor", "c1", "c2", F.lit(0).alias("at"), F.col("anchor").alias("key"), "k", "data")
    width = length - anchor_bytes(length) + 1
    to_sort, whole, names = here, None, []
    key = ["key", "d1", "d2"]
    while width > 1 and not (crowded := here.where(F.col("k") > CROWD)).isEmpty():
        width = -(-width // 4)
        names += [f"parts-{width}", f"contexts-{width}", f"several-{width}", f"rest-{width}"]
        parts = scratch.save(crowded.select("anchor", "c1", "c2", "at", "data").mapInArrow(_split(length, width), PART), names[-4])
        first = F.min(F.struct("anchor", "c1", "c2", "at")).alias("first")
        contexts = scratch.save(parts.groupBy(*key).agg(F.count("*").alias("n"), first, F.first("data").alias("data")), names[-3])
        several = scratch.save(contexts.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), names[-2])
        twice = parts.join(growing(contexts.where("n > 1").select(*key)), key)
        twice = twice.select("anchor", "c1", "c2", F.array("at", (F.col("at") + F.length("data") - F.lit(length - 1)).cast("int")).alias("runs"))
        whole = twice if whole is None else whole.unionByName(twice)
        here = scratch.save(contexts.join(growing(several), "key").select("first.*", "key", "k", "data"), names[-1])
        to_sort = to_sort.where(F.col("k") <= CROWD).unionByName(here)
    return to_sort.drop("k"), whole, names


def _sorted_shard(length: int):
    return lambda pdf: _sorted(pdf, length)


def _sorted(pdf, length: int):
    """Owned starts of one shard whose strings are equal to another's, as runs relative to each stretch."""
    import numpy as np
    import pandas as pd

    none = pd.DataFrame({"anchor": [], "c1": [], "c2": [], "runs": []}, dtype=object).astype({"anchor": "int64", "c1": "int64", "c2": "int64"})
    sizes = pdf["data"].map(len).to_numpy()
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.frombuffer(b"".join(pdf["data"]), np.uint8)
    owned = np.zeros(len(text), bool)
    for a, n in zip(firsts.tolist(), sizes.tolist()):
        owned[a : a + n - length + 1] = True
    order = suffix_array(text, length)
    order = order[owned[order]]
    # neighbours share `length` bytes if two overlapping runs of half as many or more do, which are then compared as bytes
    half = two_to(length)
    h = _rolling(text, half)
    a, b = order[:-1], order[1:]
    equal = (h[a] == h[b]) & (h[a + length - half] == h[b + length - half])
    step, near = np.arange(length), np.flatnonzero(equal)
    for k in range(0, len(near), 10_000):
        some = near[k : k + 10_000, None]
        equal[near[k : k + 10_000]] = (text[a[some] + step] == text[b[some] + step]).all(1)
    twice = np.zeros(len(text), bool)
    twice[order[:-1][equal]] = True
    twice[order[1:][equal]] = True
    out = []
    for k, (a, n) in enumerate(zip(firsts.tolist(), sizes.tolist())):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], twice[a : a + n - length + 1].view(np.int8), [0]])))
        if len(edge):
            out.append((k, (edge + pdf["at"].iloc[k]).tolist()))
    if not out:
        return none
    got = pdf.iloc[[k for k, _ in out]][["anchor", "c1", "c2"]].copy()
    got["runs"] = pd.Series([r for _, r in out], index=got.index, dtype=object)
    return got


def _cut(names: list[str], length: int):
    def run(blocks, runs):
        import hashlib

        import numpy as np
        import pandas as pd

        docs = [d for data in blocks["data"] for d in _open(data)]
        runs = runs.sort_values(["doc", "start"])
        by = np.searchsorted(runs["doc"].to_numpy(), np.arange(len(docs) + 1))
        starts, stops = runs["start"].to_numpy(), runs["stop"].to_numpy() + length - 1
        out = []
        for k, (doc_id, text, *others) in enumerate(docs):
            at, kept, n_spans = 0, [], 0
            for a, b in zip(starts[by[k] : by[k + 1]].tolist(), stops[by[k] : by[k + 1]].tolist()):
                if a > at or not n_spans:
                    kept.append(text[at:a])
                    n_spans += 1
                at = max(at, b)
            kept.append(text[at:])
            rest = b"".join(kept)
            out.append((doc_id, len(text), len(text) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if len(names) > 5 else None, *others))
        return pd.DataFrame({n: pd.Series([row[k] for row in out], dtype=object if n not in ("n_bytes", "n_removed", "n_spans") else "int64") for k, n in enumerate(names)})

    return run


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts from each text every byte that lies in a string of `length` bytes starting anywhere else too.

    Returns one row for each input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    and, if carry is a list of columns, kept_text (the rest as text; a character cut in half goes) and those
    columns as they are (their names must differ from these). Strings are judged on the input; matches never cross
    documents; all copies go, in the same document too. Null texts are empty; texts under `length` bytes stay whole, very
    long ones are taken in stretches of their starts. Repeated rows and ids are texts of their own, so they go whole if
    they are long enough; an empty table gives no rows.

    Every string of `length` bytes is owned by its anchor, so equal strings meet at equal anchors and each start is
    in one place only. Anchors that occur once settle their strings as unique; a stretch whose bytes occur twice
    settles all of its strings as repeated (copies are counted map-side, so thousands are one row); distinct
    stretches of one anchor are sorted as suffixes, shard by shard, and neighbours with `length` common bytes
    are found; where one anchor has a crowd of them, longer contexts deal it to many shards. Texts lie packed in a table bucketed by block, which both steps that need bytes read in place.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    name = f"oddsmill_blocks_{uuid.uuid4().hex}"
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(carry or []))
    rows.mapInArrow(_blocks, BLOCK).write.format("parquet").option("path", f"{scratch.root}/blocks").option("compression", "none").bucketBy(n_parts, "block").saveAsTable(name)
    blocks = spark.table(name)
    owned = scratch.save(blocks.mapInArrow(_owned(length), OWNED), "owned")
    again = owned.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    again = scratch.save(again, "anchors")  # a join of two shuffles, which AQE can split where an anchor is very common
    owned = scratch.save(owned.join(growing(again), "anchor"), "again")
    scratch.drop("owned", "anchors")
    key = ["anchor", "c1", "c2"]
    first = F.min(F.struct("block", "doc", "lo", "hi")).alias("at")
    stretches = scratch.save(owned.groupBy(*key).agg(F.count("*").alias("n"), first), "stretches")
    several = scratch.save(stretches.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), "several")
    wanted = stretches.join(growing(several), "anchor").select(*key, "k", "at.*")
    data = blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(_fetch(length), "anchor long, c1 long, c2 long, k long, data binary")
    data = scratch.save(data, "data")
    to_sort, whole, written = _by_context(data, length, scratch)
    total = to_sort.agg(F.sum(F.length("data"))).first()[0] or 0
    shards = to_sort.groupBy(F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // SHARD_BYTES)))).alias("shard"))
    found = scratch.save(shards.applyInPandas(_sorted_shard(length), FOUND), "found")
    if whole is not None:
        found, written = found.unionByName(scratch.save(whole, "whole")), [*written, "whole"]
    pairs = F.expr("transform(sequence(0, size(runs) - 2, 2), i -> struct(runs[i] as a, runs[i + 1] as b))")
    settled = stretches.where("n > 1").select(*key, F.lit(None).cast("array<struct<a:int,b:int>>").alias("runs"))
    settled = settled.unionByName(found.select(*key, pairs.alias("runs")).join(stretches.where("n > 1").select(*key), key, "left_anti"))
    hit = owned.join(growing(settled), key)
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("hi") - F.col("lo") + 1).cast("int").alias("b")))
    hit = hit.select("block", "doc", "lo", F.explode(F.coalesce("runs", whole)).alias("r"))
    hit = hit.select("block", "doc", (F.col("lo") + F.col("r.a")).alias("start"), (F.col("lo") + F.col("r.b")).alias("stop"))
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * (carry is not None))
    schema = T.StructType([*schema.fields, *rows.schema.fields[2:]])
    out = blocks.groupBy("block").cogroup(hit.groupBy("block")).applyInPandas(_cut(schema.names, length), schema)
    out = scratch.finish(out, "again", "stretches", "several", "data", "found", *written)
    spark.sql(f"drop table {name}")
    scratch.drop("blocks")
    return out
