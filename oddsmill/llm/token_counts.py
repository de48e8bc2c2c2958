"""Token counts by distinct pre-token: pieces are counted once, frequencies are joined to them, ids never exist."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, vocabulary_path

#: Texts of a chunk: the unit whose sums come together again.
MAX_ROWS = 32_768
#: A pre-token in more than this share of a chunk's texts is hot; its postings go to one bucket for each HOT_CHUNKS chunks.
HOT_SHARE, HOT_CHUNKS = 1 / 8, 64
#: Pre-tokens whose pieces a task remembers.
MEMO = 1_000_000
#: Characters in which NFC changes nothing, whose lower case is one character among them, so that the classes below are
#: complete: of those up to U+024F, some capitals have small letters beyond it.
_PLAIN = "".join(c for c in map(chr, [9, 10, 13, *range(0x20, 0x7F), *range(0xA0, 0x250)]) if len(c.lower()) == 1 and c.lower() <= "ɏ")
PLAIN = re.compile(f"[{re.escape(_PLAIN)}]*")
_L, _N = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN_PRETOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\t\n\r \xa0{_L}{_N}]+")

LISTS = "bucket int, chunk long, words binary, lists binary, doc_ids array<long>, n_bytes array<long>"
SUMS = "chunk long, sums binary, doc_ids array<long>, n_bytes array<long>"


class Pretokens:
    """Splits a text as the vocabulary file asks, before any piece is looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def __call__(self, text: str) -> list[str]:
        if self.special is None or self.special.search(text) is None:
            return self.ordinary(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self.ordinary(part)
        return out

    def ordinary(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return PLAIN_PRETOKENS.findall(text.lower())
        t = self.tokenizer
        text = t.normalizer.normalize_str(text)
        # the byte-level alphabet has one character for a byte; the offsets give back the characters
        return [text[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(text)]


def _pack(*arrays) -> bytes:
    import pyarrow as pa

    head = b"".join(len(x).to_bytes(8, "little") for x in arrays)
    return pa.compress(head + b"".join(x.tobytes() for x in arrays), codec="zstd", asbytes=True)


def _unpack(data: bytes, *types: str):
    import numpy as np
    import pyarrow as pa

    data = pa.input_stream(pa.BufferReader(data), compression="zstd").read()
    at, out = 8 * len(types), []
    for n, t in zip(np.frombuffer(data, "<u8", len(types)).tolist(), types):
        out.append(np.frombuffer(data, t, n, at))
        at += out[-1].nbytes
    return out


def _lists(path: str, n_buckets: int):
    """Posting lists of each chunk by bucket of the pre-token, and a row with the chunk's ids and sizes."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        split, part, chunks = Pretokens(path), TaskContext.get().partitionId(), 0
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("lists", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64()))])
        ids: list[int | None] = []
        sizes: list[int] = []
        words: dict[str, int] = {}
        found: list[tuple] = []

        def flush():
            nonlocal chunks
            chunk, chunks = part << 32 | chunks, chunks + 1
            rows = [{"bucket": chunk % n_buckets, "chunk": chunk, "doc_ids": list(ids), "n_bytes": list(sizes)}]
            if found:
                word, text, freq = (np.concatenate(x) for x in zip(*found))
                in_texts = np.bincount(word, minlength=len(words))
                salt = str(part // HOT_CHUNKS)
                bucket = np.array([zlib.crc32((w + salt if n > HOT_SHARE * len(ids) else w).encode("utf-8", "surrogatepass")) % n_buckets for w, n in zip(words, in_texts.tolist())])
                names = np.array(list(words), object)
                by_bucket = np.argsort(bucket, kind="stable")
                place = np.empty_like(by_bucket)
                place[by_bucket] = np.arange(len(by_bucket))
                order = np.argsort(place[word], kind="stable")
                text, freq, in_texts = text[order], freq[order], in_texts[by_bucket]
                entry_ends = np.concatenate([[0], np.cumsum(in_texts)])
                ends = np.searchsorted(bucket[by_bucket], np.arange(n_buckets + 1))
                for k in range(n_buckets):
                    a, b = ends[k], ends[k + 1]
                    if a < b:
                        at = slice(entry_ends[a], entry_ends[b])
                        own = "\n".join(names[by_bucket[a:b]]).encode("utf-8", "surrogatepass")
                        rows.append({"bucket": k, "chunk": chunk, "words": pa.compress(own, codec="zstd", asbytes=True), "lists": _pack(in_texts[a:b].astype("<u4"), text[at].astype("<u2"), freq[at].astype("<u4"))})
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[k : k + 256], schema=schema)
            ids.clear(), sizes.clear(), words.clear(), found.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if got := split(text):
                    w, n = np.unique(np.fromiter((words.setdefault(x, len(words)) for x in got), np.int32, len(got)), return_counts=True)
                    found.append((w, np.full(len(w), len(ids), np.uint16), n.astype(np.uint32)))
                ids.append(doc_id)
                sizes.append(len(text.encode()))
                if len(ids) == MAX_ROWS or len(words) > 600_000:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def _sums(path: str):
    """Of one bucket: pieces of each pre-token, counted when it is first met, times its frequencies, by text."""

    def run(batches: Iterator) -> Iterator:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer, normalizers

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        t.normalizer = normalizers.Sequence([])  # pre-tokens are normal already
        pieces: dict[str, int] = {}
        schema = pa.schema([("chunk", pa.int64()), ("sums", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64()))])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["words"] is None:
                    out.append({k: row[k] for k in ("chunk", "doc_ids", "n_bytes")})
                    continue
                words = pa.input_stream(pa.BufferReader(row["words"]), compression="zstd").read().decode("utf-8", "surrogatepass").split("\n")
                if len(pieces) > MEMO:
                    pieces.clear()
                new = [w for w in words if w not in pieces]
                pieces.update(zip(new, (len(x.ids) for x in t.encode_batch_fast(new, add_special_tokens=False))))
                in_texts, text, freq = _unpack(row["lists"], "<u4", "<u2", "<u4")
                n = np.repeat(np.fromiter((pieces[w] for w in words), np.int64, len(words)), in_texts) * freq
                total = np.bincount(text, n).astype(np.int64)
                at = np.flatnonzero(total)
                out.append({"chunk": row["chunk"], "sums": _pack(at.astype("<u2"), total[at].astype("<u8"))})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _totals(limit: int):
    def run(pdf):
        import numpy as np
        import pandas as pd

        ids, sizes = next((i, n) for i, n in zip(pdf["doc_ids"], pdf["n_bytes"]) if i is not None)
        total = np.zeros(len(ids), np.int64)
        for data in pdf["sums"]:
            if data is not None:
                at, n = _unpack(data, "<u2", "<u8")
                total[at] += n.astype(np.int64)
        return pd.DataFrame({"doc_id": pd.array(list(ids), "Int64"), "n_bytes": sizes, "n_tokens": total, "over_limit": total > limit})

    return run


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every text under a public vocabulary: (doc_id, n_bytes, n_tokens, over_limit).

    One row for each input row, repeated rows and null ids included; a null or empty text has no bytes and no
    tokens. Texts are taken whole. Special strings inside a text are one token each, as the library has it.
    Columns beside the two named ones are ignored, whatever their names; an empty table gives no rows. Rows are
    counted one by one, so nothing depends on an order and there are no ties.

    Plan: a task turns each chunk of its rows into posting lists (texts and frequencies by pre-token), packed by
    a hash of the pre-token into one row a bucket. A bucket counts the pieces of each distinct pre-token once,
    multiplies, and sends one packed row of sums back to each chunk. A row for each word occurrence never
    exists, and a pre-token in most texts is dealt to one bucket for each HOT_CHUNKS tasks.
    """
    path, spark = vocabulary_path(vocabulary), docs.sparkSession
    scratch = Scratch(spark, "tokens")
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # chunks number the rows as they come, so the lists are written once: a task that runs again reads the same ones
    lists = scratch.save(rows.mapInArrow(_lists(path, n_buckets), LISTS), "lists")
    sums = lists.repartition(n_buckets, "bucket").mapInArrow(_sums(path), SUMS)
    totals = sums.groupBy("chunk").applyInPandas(_totals(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    return scratch.finish(totals, "lists")
