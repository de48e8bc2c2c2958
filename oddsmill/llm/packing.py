"""Best-fit packing: patterns of a few lengths fitted to the histogram by non-negative least squares, residuals by best fit."""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, vocabulary_path

#: Rows that one task packs; more rows make more tasks, and each loses less than one sequence.
GROUP_ROWS = 40_000
#: Lengths are rounded up to this grain for patterns only.
GRAIN = 32
#: Tokens that a sequence laid by a pattern may leave empty.
SLACK = 0
#: Documents of a pattern.
PATTERN_DOCS = 3
#: Documents shorter than this part of a sequence aren't in patterns: the residual pass fills its gaps with them.
FILLERS = 3 / 16
#: Pre-tokens whose ids a task remembers.
MEMO = 1_000_000

_L, _N = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Characters whose classes are complete in PRETOKENS, the vocabulary's own split.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-ɏ]*")
PRETOKENS = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


class TokenIds:
    """The ids of whole texts as little-endian bytes, as the library gives them.

    A pre-token's ids don't depend on its neighbours, so the library finds those of each distinct one once and a task
    remembers them; texts with characters outside PLAIN or with added tokens go through the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.memo: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or (self.added is not None and self.added.search(text)):
            return self._encoded(text)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        words = PRETOKENS.findall(text)
        new = [w for w in set(words) if w not in memo]
        if new:
            memo.update(zip(new, map(self._bytes, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        return b"".join(map(memo.__getitem__, words))

    def _encoded(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False))

    @staticmethod
    def _bytes(found) -> bytes:
        return array("I", found.ids).tobytes()


@functools.cache
def token_ids(path: str) -> TokenIds:
    """One for a worker, whose tasks remember the same pre-tokens."""
    return TokenIds(path)


def _pieces(path: str, limit: int, end_id: int):
    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        ids, end, row = token_ids(path), end_id.to_bytes(4, "little"), TaskContext.get().partitionId() << 40
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = ids(text.as_py() or "") + end
                n = len(data) // 4
                cuts = [0, *range(n % limit or limit, n + 1, limit)] if n > limit else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(out, (row, doc_id, k, a, b - a, zlib.crc32(data[4 * a : 4 * b]))):
                        column.append(value)
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return run


def nnls(a, b, rounds: int):
    """Non-negative x with a x near b: the active-set method, one column let in at a time."""
    import numpy as np

    x, gram, right = np.zeros(a.shape[1]), a.T @ a, a.T @ b
    free = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = right - gram @ x
        gain[free] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        free[k] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.solve(gram[np.ix_(at, at)] + 1e-9 * np.eye(len(at)), right[at])
            if s.min(initial=1.0) > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            free[at[x[at] <= 1e-12]] = False
            x[~free] = 0
    return x


def fit_patterns(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], float]]:
    """Patterns of up to PATTERN_DOCS rounded lengths that fill a sequence, with the repeat counts that fit best.

    The histogram has at most `limit` entries, so this is one small problem at any size of the corpus. Short documents
    stand outside it (FILLERS): what patterns leave is packed without loss only while there are some to fill gaps with.
    """
    import numpy as np

    n_bins = limit // GRAIN
    have = np.zeros(n_bins + 1)
    for length, n in histogram.items():
        if length < limit:
            have[-(-length // GRAIN)] += n
    have[: int(n_bins * FILLERS)] = 0
    patterns = [(a, n_bins - a) for a in range((n_bins + 1) // 2, n_bins)]
    patterns += [(a, b, n_bins - a - b) for a in range(-(-n_bins // 3), n_bins - 1) for b in range(-(-(n_bins - a) // 2), min(a, n_bins - a - 1) + 1)]
    patterns = [p for p in patterns if all(have[x] for x in p)]
    if not patterns:
        return []
    a = np.zeros((n_bins + 1, len(patterns)))
    for k, p in enumerate(patterns):
        for x in p:
            a[x, k] += 1
    x = nnls(a, have, 2 * n_bins)
    return [(patterns[k], float(x[k])) for k in np.flatnonzero(x)]


def rounded(repeats: list[float]) -> list[int]:
    """Whole numbers near these, with the whole part of their sum as their sum: largest remainders go up."""
    low = [int(x) for x in repeats]
    up = sorted(range(len(repeats)), key=lambda k: (low[k] - repeats[k], k))[: int(sum(repeats) + 1e-9) - sum(low)]
    return [n + (k in set(up)) for k, n in enumerate(low)]


def share(n: int, k: int, group: int, n_groups: int) -> int:
    """Of n repeats of pattern k, those of one of the groups; no two groups differ by more than one."""
    g = (group + k) % n_groups
    return n * (g + 1) // n_groups - n * g // n_groups


def _laid(lengths, order, patterns: list[tuple[tuple[int, ...], int]], limit: int):
    """Sequence and offset of each piece, the number of sequences, and how many of them patterns laid: these come first, then
    best fit decreasing packs the rest into gaps and new sequences."""
    import bisect

    import numpy as np

    seq, at = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []

    def put(k: int, s: int) -> None:
        seq[k], at[k] = s, used[s]
        used[s] += int(lengths[k])

    bins: dict[int, list[tuple[int, int]]] = {}
    for k in order[::-1] if patterns else ():
        bins.setdefault(-(-int(lengths[k]) // GRAIN), []).append((int(lengths[k]), int(k)))  # the longest of a bin is last
    for pattern, repeats in patterns:
        for _ in range(repeats):
            if any(len(bins.get(x, ())) < pattern.count(x) for x in pattern):
                break
            head = [bins[x].pop() for x in pattern[:-1]]
            gap = limit - sum(length for length, _ in head)
            # the last place takes a document that fits to SLACK, which rounding may put one or two bins up;
            # where there is none, the others wait for the residuals
            for x in range(gap // GRAIN + 1, (gap - SLACK - 1) // GRAIN, -1):
                own = bins.get(x, [])
                n = bisect.bisect_right(own, (gap, len(lengths)))
                if n and own[n - 1][0] >= gap - SLACK:
                    used.append(0)
                    for _, k in [*head, own.pop(n - 1)]:
                        put(k, len(used) - 1)
                    break
    laid = len(used)
    gaps: list[list[int]] = [[] for _ in range(limit + 1)]
    some = 0
    for s, u in enumerate(used):
        gaps[limit - u].append(s)
        some |= 1 << (limit - u)
    for k in order:
        if seq[k] >= 0:
            continue
        need = int(lengths[k])
        fits = some >> need
        if fits:
            gap = need + (fits & -fits).bit_length() - 1
            s = gaps[gap].pop()
            if not gaps[gap]:
                some ^= 1 << gap
        else:
            used.append(0)
            s, gap = len(used) - 1, limit
        put(k, s)
        if gap > need:
            gaps[gap - need].append(s)
            some |= 1 << (gap - need)
    return seq, at, len(used), laid


def _pack(patterns: list[tuple[tuple[int, ...], int]], n_groups: int, limit: int):
    def run(pdf):
        import numpy as np

        lengths, group = pdf["length"].to_numpy(), int(pdf["pack"].iloc[0])
        order = np.lexsort((pdf["row"].to_numpy(), -lengths))
        own = [(p, share(n, k, group, n_groups)) for k, (p, n) in enumerate(patterns)]
        seq, at, _, laid = _laid(lengths, order, own, limit)
        out = pdf.drop(columns=["row", "pack"])
        out["sequence_id"] = (group << 32) + seq
        out["offset"] = at
        out["by_pattern"] = seq < laid
        return out

    return run


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of all documents in sequences of at most `limit` tokens: one row a piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and by_pattern, whether a pattern laid its
    sequence's first pieces. A document is its ids and `end_id`, so
    a null or empty text is one token. Only documents over the limit are cut; their first piece is the short
    one. Repeated rows, ties in length and null ids are packed one by one; an empty table gives no rows. A very long
    text is as many pieces as it needs, in any sequences. Ids aren't moved: `sequences` joins them back.

    Pieces are dealt by a hash to tasks of about GROUP_ROWS rows. Patterns are fitted once to the histogram of
    lengths (at most `limit` rows on the driver) and their repeats rounded as a whole, by largest remainders; each
    task lays its whole share of them, then packs what is left by best fit decreasing into the gaps and new
    sequences. Documents under FILLERS of a sequence are left to that, so that there is something for every gap.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.save(rows.mapInArrow(_pieces(vocabulary_path(vocabulary), limit, end_id), PIECES), "pieces")
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    total = sum(histogram.values())
    n_groups = max(1, -(-total // GROUP_ROWS))
    dealt = pieces.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(n_groups)))
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, by_pattern boolean"
    fitted = fit_patterns(histogram, limit)
    patterns = list(zip([p for p, _ in fitted], rounded([x for _, x in fitted])))
    packed = dealt.groupBy("pack").applyInPandas(_pack(patterns, n_groups, limit), fields)
    return scratch.finish(packed, "pieces")


def sequences(placed: DataFrame, docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: (sequence_id, input_ids, doc_ids). Needs unique ids."""
    path = vocabulary_path(vocabulary)

    def cut(batches: Iterator) -> Iterator:
        import numpy as np

        ids = token_ids(path)
        for pdf in batches:
            whole = [np.frombuffer(ids(t or "") + end_id.to_bytes(4, "little"), "<u4") for t in pdf["text"]]
            pdf["input_ids"] = [w[s : s + n].astype("int32") for w, s, n in zip(whole, pdf["start"], pdf["length"])]
            yield pdf[["sequence_id", "offset", "doc_id", "input_ids"]]

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cuts = placed.join(texts, "doc_id").select("doc_id", "text", "start", "length", "sequence_id", "offset")
    cuts = cuts.mapInPandas(cut, "sequence_id long, offset long, doc_id long, input_ids array<int>")
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "input_ids")))
    return cuts.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.input_ids").alias("input_ids"), F.col("p.doc_id").alias("doc_ids"))
