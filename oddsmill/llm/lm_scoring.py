"""Language-model scoring by a weighted backoff automaton whose arcs are counted over the whole corpus."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_bucket
from .shingles import PLACES, Shingler, mix

#: Text bytes of a block at least, what one task holds with its part of the automaton; and bytes of a block for each
#: bucket of keys, so that the rows which blocks send to buckets stay in proportion to the input.
BLOCK_BYTES, ROW_BYTES = 10_000_000, 2048
#: Smoothing of single words.
ADD = 0.1
#: The end token, and the state in which a text begins.
END, BEGIN = 0x517CC1B727220A95, 0x2545F4914F6CDD1D
#: Orders above single words, by name: runs of two and of three tokens, whose first ones are a state.
ORDERS = ("words", "pairs", "triples")
#: Bits of a key of three tokens: among 10^12 different ones, one in 70,000 shares its key. Shorter runs have all 64.
TRIPLE_BITS = 56
#: Bounds of the prior of an order.
LEAST_PRIOR, MOST_PRIOR = 1e-3, 1e6

BLOCK = "block long, data binary"
KEYS = "bucket int, block long, words binary, pairs binary, triples binary"
COUNTS = "block long, bucket int, words binary, pairs binary, triples binary, n long, v long, shape binary"


def _planes(*arrays) -> bytes:
    """Arrays of integers by planes of their bytes, so that empty high bytes cost nothing."""
    import numpy as np
    import pyarrow as pa

    flat = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return pa.compress(len(arrays[0]).to_bytes(8, "little") + flat, codec="zstd", asbytes=True)


def _unplanes(data: bytes, *types: str):
    import numpy as np
    import pyarrow as pa

    data = pa.input_stream(pa.BufferReader(data), compression="zstd").read()
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for t in types:
        width = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(t).reshape(n))
        at += n * width
    return out


def _blocks(most: int):
    """Texts gathered to blocks, one packed row each."""

    def run(batches: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa
        from pyspark import TaskContext

        n, rows, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            data = pa.compress(pickle.dumps(rows), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["block", "data"])

        for batch in batches:
            for doc_id, trained, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if rows and size + len(text) > most:
                    yield flush()
                    n, rows, size = n + 1, [], 0
                rows.append((doc_id, trained, text))
                size += len(text) + 64
        if rows:
            yield flush()

    return run


class Tokens:
    """A block's tokens in order, and the keys of the runs of one, two and three that end at each; the same each time it
    is opened. The first token of a text has no run of three. A run of two that ends a text is marked by its last bit,
    since it is no state."""

    def __init__(self, data: bytes, shingler: Shingler):
        import pickle

        import numpy as np
        import pyarrow as pa

        rows = pickle.loads(pa.input_stream(pa.BufferReader(data), compression="zstd").read())
        self.doc_ids, self.trained = [r[0] for r in rows], np.array([r[1] for r in rows], bool)
        texts = [np.append(shingler.words(r[2]), np.uint64(END)) for r in rows]
        self.ends = np.cumsum([len(t) for t in texts])
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.words = np.concatenate(texts)
        first = np.zeros(len(self.words), bool)
        first[self.starts] = True
        before = np.concatenate([[np.uint64(BEGIN)], self.words[:-1]])
        before[first] = BEGIN
        one = np.uint64(1)
        self.pairs = mix(before * np.uint64(PLACES[0]) + self.words * np.uint64(PLACES[1])) & ~one
        self.pairs[self.ends - 1] |= one
        earlier = np.concatenate([[np.uint64(0)], self.pairs[:-1]])
        self.later = np.flatnonzero(~first)  # places of tokens that end a run of three
        self.triples = mix(earlier[self.later] * np.uint64(PLACES[2]) + self.words[self.later] * np.uint64(PLACES[3]))
        self.triples &= np.uint64((1 << 64) - (1 << 64 - TRIPLE_BITS))
        self.in_training = np.repeat(self.trained, self.ends - self.starts)

    def keys(self, which: str):
        """Sorted distinct keys, and the training count of each."""
        import numpy as np

        keys = getattr(self, which)
        trained = np.sort(keys[self.in_training[self.later] if which == "triples" else self.in_training])
        keys = np.sort(keys)
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        return keys, (np.searchsorted(trained, keys, "right") - np.searchsorted(trained, keys)).astype(np.uint32)


def _keys(n_buckets: int):
    """For each bucket of the key range: the block's keys there, as gaps, with their training counts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingler = Shingler(1)
        cuts = np.array([(k << 64) // n_buckets for k in range(1, n_buckets)], np.uint64)
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens, packed, some = Tokens(data.as_py(), shingler), [], np.zeros(n_buckets, bool)
                for which in ORDERS:
                    keys, count = tokens.keys(which)
                    ends = np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])
                    some |= np.diff(ends) > 0
                    packed.append([_planes(np.diff(keys[a:b], prepend=np.uint64(0)), count[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())])
                at = np.flatnonzero(some).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([block] * len(at), pa.int64()), *(pa.array([x[k] for k in at], pa.binary()) for x in packed)], names=["bucket", "block", *ORDERS])

    return run


def _binned(counts):
    """Counts over 1024 to four digits of a power of two: few values at any size of the corpus."""
    import numpy as np

    step = np.uint64(1) << np.maximum(np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) - 10, 0).astype(np.uint64)
    return counts // step * step


def _counts(pdf):
    """Of one bucket: corpus counts of all its keys, given back to each block in the order of the block's own keys, and
    how many states and runs have each count."""
    import pickle

    import numpy as np
    import pandas as pd

    out, shape, n, v = {}, {}, 0, 0
    for which in ORDERS:
        keys, counts = zip(*(_unplanes(x, "<u8", "<u4") for x in pdf[which]))
        ends = np.cumsum([0, *map(len, keys)])
        distinct, at = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k in keys]), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), minlength=len(distinct)).astype(np.uint64)
        if which == "words":
            n, v = int(total.sum()), int((total > 0).sum())
        once = int((total == 1).sum())
        states = total[(total > 0) & (distinct & np.uint64(1) == 0)] if which == "pairs" else total[total > 0]
        shape[which] = (once, *np.unique(_binned(states), return_counts=True))
        out[which] = [_planes(total[at[a:b]]) for a, b in zip(ends, ends[1:])]
    got = pd.DataFrame({"block": pdf["block"].to_numpy(), "bucket": int(pdf["bucket"].iloc[0]), **out, "n": 0, "v": 0, "shape": None})
    got.loc[0, ["n", "v"]] = n, v
    got.at[0, "shape"] = pickle.dumps(shape)
    return got


def _shapes(batches: Iterator) -> Iterator:
    """Rows (order, count, n) of all buckets; count 0 stands for the runs that occur once."""
    import pickle

    import pyarrow as pa

    for batch in batches:
        rows = []
        for data in batch.column(0).to_pylist():
            for which, (once, counts, n) in pickle.loads(data).items():
                rows += [(which, 0, once), *((which, int(c), int(k)) for c, k in zip(counts, n))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["order", "count", "n"])


def fit_prior(states: Sequence[tuple[int, int]], once: int) -> float:
    """The prior m of an order, by which a state of count c fails with weight m / (c + m).

    It gives the failure arcs, over all tokens, the share that Good and Turing estimate for runs not seen before: as many
    tokens as there are runs that occurred once. states: (count, number of states with it).
    """
    low, high = LEAST_PRIOR, MOST_PRIOR
    for _ in range(80):
        m = (low * high) ** 0.5
        low, high = (m, high) if sum(k * c * m / (c + m) for c, k in states) < once else (low, m)
    return (low * high) ** 0.5


class Automaton:
    """States, arcs and failure arcs of the runs that one block needs.

    States are the root, words and runs of two, by the training count of what they stand for; each has a failure arc to
    its suffix, weighted m / (c + m). A seen run of one more token is an arc, weighted (count + m * weight from the
    suffix) / (c + m); all weights from a state add up to one.
    """

    def __init__(self, total: int, distinct: int, priors: tuple[float, float]):
        self.total, self.distinct, self.priors = total, distinct, priors

    def root(self, count):
        return (count + ADD) / (self.total + ADD * (self.distinct + 1))

    def failure(self, state, order: int):
        """Weight of the failure arc of states with these counts."""
        m = self.priors[order]
        return m / (state + m)

    def arc(self, state, count, suffix, order: int):
        """Weight of the arc of a run with this count, or of the failure arc and what follows where there is none."""
        return count / (state + self.priors[order]) + self.failure(state, order) * suffix

    def walk(self, tokens: Tokens, count: dict):
        """Weight of each token from the state before it, and 0 to 2, the tokens that the state after it stands for.

        The state after a token is the longest known run that ends there, whatever came before, so it is read off the
        counts and all places are walked at once.
        """
        import numpy as np

        n, first = len(tokens.words), tokens.starts
        word = count["words"]
        after = np.where(word > 0, 1, 0)
        after[(count["pairs"] > 0) & (np.bitwise_and(tokens.pairs, np.uint64(1)) == 0)] = 2
        after[tokens.ends - 1] = 0
        before = np.concatenate([[0], after[:-1]])
        single = np.concatenate([[0.0], word[:-1]])  # count of the last token
        single[first] = word[tokens.ends[0] - 1]  # a training text begins for each end
        before[first] = single[first] > 0
        double = np.concatenate([[0.0], count["pairs"][:-1]])
        triple = np.zeros(n)
        triple[tokens.later] = count["triples"]
        weight = self.root(word)
        one = before >= 1
        weight[one] = self.arc(single[one], count["pairs"][one], weight[one], 0)
        two = before == 2
        weight[two] = self.arc(double[two], triple[two], weight[two], 1)
        return weight, after


def _score(total: int, distinct: int, priors: tuple[float, float]):
    def run(blocks, parts):
        import numpy as np
        import pandas as pd

        automaton, parts, out = Automaton(total, distinct, priors), parts.sort_values("bucket"), []
        for data in blocks["data"]:
            tokens, count = Tokens(data, Shingler(1)), {}
            for which in ORDERS:
                found = np.concatenate([_unplanes(x, "<u8")[0] for x in parts[which]])
                count[which] = found[np.unique(getattr(tokens, which), return_inverse=True)[1]].astype(float)
            weight, _ = automaton.walk(tokens, count)
            over = lambda x: np.add.reduceat(x, tokens.starts)  # noqa: E731, B023
            word = count["words"]
            out.append(pd.DataFrame({"doc_id": pd.array(tokens.doc_ids, "Int64"), "held_out": ~tokens.trained, "n_tokens": tokens.ends - tokens.starts, "n_known": over((word > 0).astype(np.int64)), "train_tokens": total, "base_score": over(np.log10(automaton.root(word))), "score": over(np.log10(weight))}))
        return pd.concat(out)

    return run


def score_texts(docs: DataFrame, trained=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probabilities of all texts under a model learned from those where `trained` holds.

    Returns one row for each input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (single
    words, additive smoothing) and score (the automaton, runs of up to three tokens). `trained` is a boolean column over
    the input; by default crc32 of the id as text, modulo 10, isn't 0, and a null id is held out. Words are lower-cased
    (A-Z only); the end is a token of each text, so null and empty texts have one. Repeated rows and ids are texts of
    their own; a very long text is one block. With no training text every token is unknown and both scores are its
    smoothed share of nothing, log10(1) a token. An empty table gives no rows.

    The model is never in one place. Blocks of texts send their distinct runs of one, two and three tokens, packed, to
    buckets of the key range; a bucket adds up the corpus counts and gives each block back those of its own keys, in
    order and without the keys; a block then has the automaton it needs. Runs that are everywhere cost each block one
    entry. Blocks grow with the number of buckets (spark.sql.shuffle.partitions), so that there are no more rows than
    one for ROW_BYTES of text. The prior of each order is fitted to how many states have each count.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    name = f"oddsmill_blocks_{uuid.uuid4().hex}"
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trained = F.coalesce(crc_bucket(F.col(id_col), 10) != 0 if trained is None else trained, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), trained.alias("trained"), F.col(text_col).cast("string").alias("text"))
    try:
        packed = rows.mapInArrow(_blocks(max(BLOCK_BYTES, ROW_BYTES * n_buckets)), BLOCK)
        packed.write.format("parquet").option("path", f"{scratch.root}/blocks").option("compression", "none").bucketBy(n_buckets, "block").saveAsTable(name)
        blocks = spark.table(name)
        counts = scratch.save(blocks.mapInArrow(_keys(n_buckets), KEYS).groupBy("bucket").applyInPandas(_counts, COUNTS), "counts")
        n, v = counts.agg(F.sum("n"), F.sum("v")).first()
        shape = counts.select("shape").where("shape is not null").mapInArrow(_shapes, "order string, count long, n long").groupBy("order", "count").agg(F.sum("n").alias("n"))
        by: dict[str, list[tuple[int, int]]] = {which: [] for which in ORDERS}
        once = dict.fromkeys(ORDERS, 0)
        for r in shape.collect():  # a few thousand rows at any size
            if r["count"]:
                by[r.order].append((r["count"], r.n))
            else:
                once[r.order] = r.n
        priors = fit_prior(by["words"], once["pairs"]), fit_prior(by["pairs"], once["triples"])
        fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        parts = counts.select("block", "bucket", *ORDERS)
        out = blocks.groupBy("block").cogroup(parts.groupBy("block")).applyInPandas(_score(int(n or 0), int(v or 0), priors), fields)
        return scratch.finish(out, "counts")
    finally:
        spark.sql(f"drop table if exists {name}")
        scratch.drop("blocks")
