"""Language identification by unigram pieces, a word's probability being the sum over all its segmentations."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_bucket, vocabulary_path

LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of texts whose characters all lie under U+0250, where the class is a short list of ranges.
PLAIN, PLAIN_LETTERS = re.compile("[\0-\u024f]*"), re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f]+")
#: Added to every count of a piece.
ALPHA = 0.1
#: Passes of expectation and maximisation over all segmentations, after a start from one segmentation of each word.
PASSES = 2
#: The model is one number for each piece of the vocabulary and language; more languages are refused.
MAX_LANGS = 1024
#: Distinct words that a task remembers, and cells (words times letters) of one group in a forward pass.
MEMO, CELLS = 400_000, 60_000
EDGE = "▁"
#: Characters of texts that are cut to words at a time; a longer text is a run of its own.
RUN_CHARS = 500_000
#: Places between two rescalings: a place weighs at least (ALPHA / corpus) ** 4, so four stay within a double.
RESCALE = 4


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    text = text.lower()
    if PLAIN.fullmatch(text):
        return PLAIN_LETTERS.findall(text)
    return [w for w in LETTERS.findall(text) if w.isalpha() or any(map(str.isalpha, w))]


def _runs(texts) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Words of a column's texts in runs of RUN_CHARS characters, with their places; texts without a word are left out."""
    at, found, size = [], [], 0
    for k, text in enumerate(texts):
        text = text.as_py() or ""
        words = words_of(text)
        if words:
            at.append(k)
            found.append(words)
            size += len(text)
            if size > RUN_CHARS:
                yield at, found
                at, found, size = [], [], 0
    if at:
        yield at, found


def _words(batches: Iterator) -> Iterator:
    """Distinct words of each language in a task, with their counts."""
    from collections import Counter

    import pyarrow as pa

    seen: dict[str, Counter] = {}

    def flush():
        for lang, counter in seen.items():
            words, counts = list(counter), list(counter.values())
            for k in range(0, len(words), 50_000):
                some = words[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.string()), pa.array(counts[k : k + 50_000], pa.int64())], names=["lang", "word", "n"])
        seen.clear()

    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            seen.setdefault(lang, Counter()).update(words_of(text))
            size += len(text)
            if size > RUN_CHARS:
                size = 0
                if sum(map(len, seen.values())) > MEMO:
                    yield from flush()
    yield from flush()


def _counted(expect):
    """Rows (lang, word, n) to (lang, piece, n), added up in the task; expect(lang, words, n) has a number for each piece."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            langs, words, n = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            by: dict[str, list[int]] = {}
            for k, lang in enumerate(langs):
                by.setdefault(lang, []).append(k)
            for lang, at in by.items():
                found = expect(lang, [words[k] for k in at], n[at].astype(float))
                sums[lang] = found + sums.get(lang, 0)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], names=["lang", "piece", "n"])

    return run


def _one_segmentation(path: str):
    """The start: pieces of the one segmentation that the vocabulary's own merges give."""
    held: list = []

    def expect(lang, words, n):
        import numpy as np
        import sentencepiece

        if not held:
            held.append(sentencepiece.SentencePieceProcessor(model_file=path))
        ids = held[0].encode(words, num_threads=1)
        at = np.concatenate([np.array(x, np.int64) for x in ids])
        return np.bincount(at, np.repeat(n, [len(x) for x in ids]), held[0].vocab_size())

    return _counted(expect)


def _all_segmentations(model):
    """Expected pieces of each word over all its segmentations under the model so far."""
    held: list = []

    def expect(lang, words, n):
        if not held:
            held.append(model.value.open())
        return held[0].expected(lang, words, n)

    return _counted(expect)


class Model:
    """Piece probabilities by language, small enough for every task: vocabulary times languages."""

    def __init__(self, langs: list[str], table, path: str):
        self.langs, self.table, self.path = langs, table, path  # table: [pieces, langs] counts

    def open(self) -> Model:
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=self.path)
        self.p = (self.table + ALPHA) / (self.table + ALPHA).sum(0)
        by: dict[int, list[tuple[int, int]]] = {}
        self.bytes = np.zeros(256, np.int64)
        for k in range(sp.vocab_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
            elif not (sp.is_control(k) or sp.is_unknown(k)):
                by.setdefault(len(piece), []).append((self._hash(piece), k))
        self.pieces = {n: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([k for _, k in sorted(x)])) for n, x in by.items()}
        self.longest = max(self.pieces)
        return self

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _arcs(self, words: list[str]):
        """Pieces at all places of words of one length: word, first place, end, id, ordered by (end, word); at least one
        for each end and word, since a letter outside the vocabulary is an arc over its bytes (ids from the table's end on)."""
        import numpy as np

        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n).astype(np.uint64)
        found: list[list] = [[], [], [], []]
        h = np.zeros((len(words), n + 1), np.uint64)
        for length in range(1, min(self.longest, n) + 1):
            h = h[:, : n - length + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[:, length - 1 :] + np.uint64(1)
            hashes, ids = self.pieces.get(length, (np.zeros(1, np.uint64), np.full(1, -1)))
            at = np.minimum(np.searchsorted(hashes, h.ravel()), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == h.ravel())
            word, start = np.divmod(hit, n - length + 1)
            for column, x in zip(found, (word, start, start + length, ids[at[hit]])):
                column.append(x)
            if length == 1:
                missing = np.ones(codes.size, bool)
                missing[hit] = False
                word, start = np.divmod(np.flatnonzero(missing), n)
                letters, which = np.unique(codes[word, start], return_inverse=True)
                for column, x in zip(found, (word, start, start + 1, len(self.p) + which)):
                    column.append(x)
        word, start, end, ids = map(np.concatenate, found)
        order = np.lexsort((word, end))
        spelt = [self.bytes[list(chr(int(c)).encode("utf-8", "surrogatepass"))] for c in letters]
        return word[order], start[order], end[order], ids[order], spelt

    def _forward(self, words: list[str], p):
        """The arcs, their weights, and the forward values with the log scale by which each place's are divided."""
        import numpy as np

        n, many = len(words[0]), len(words)
        word, start, end, ids, spelt = self._arcs(words)
        if spelt:
            p = np.concatenate([p, [p[x].prod(0) for x in spelt]])
        weight = p[ids]
        first = np.searchsorted(end * many + word, np.arange(many, (n + 1) * many + 1))  # of each (end, word)
        forward, scale = np.zeros((n + 1, many, p.shape[1])), np.zeros((n + 1, many, p.shape[1]))
        forward[0] = 1
        for e in range(1, n + 1):
            a, b = first[(e - 1) * many], first[e * many]
            forward[e] = np.add.reduceat(forward[start[a:b], word[a:b]] * weight[a:b], first[(e - 1) * many : e * many] - a)
            scale[e] = scale[e - 1]
            if e % RESCALE == 0:
                by = forward[e].copy()
                lo = max(0, e - self.longest)
                forward[lo : e + 1] /= by
                scale[lo : e + 1] += np.log(by)
        return (word, start, end, ids, spelt), weight, forward, scale

    def _groups(self, words: list[str]):
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(k)
        for n, at in by.items():
            step = max(1, CELLS // n)
            for a in range(0, len(at), step):
                yield at[a : a + step], [EDGE + words[k] for k in at[a : a + step]]

    def score(self, words: list[str]):
        """Log probabilities, [words, langs]: a forward pass over the places of all words of one length at once."""
        import numpy as np

        out = np.zeros((len(words), len(self.langs)))
        for at, some in self._groups(words):
            _, _, forward, scale = self._forward(some, self.p)
            out[at] = np.log(forward[-1]) + scale[-1]
        return out

    def expected(self, lang: str, words: list[str], n):
        """Expected counts of all pieces in these words of one language, each word n times: forward and backward."""
        import numpy as np

        p, out = self.p[:, [self.langs.index(lang)]], np.zeros(len(self.p))
        for at, some in self._groups(words):
            (word, start, end, ids, spelt), weight, forward, scale = self._forward(some, p)
            length, many = len(some[0]), len(some)
            # backward values under the same log scales, so that every product below is a share of one
            backward = np.zeros_like(forward)
            backward[-1] = 1
            order = np.lexsort((word, start))
            first = np.searchsorted((start * many + word)[order], np.arange(length * many + 1))
            for s in range(length - 1, -1, -1):
                arcs = order[first[s * many] : first[(s + 1) * many]]
                e, w = end[arcs], word[arcs]
                value = weight[arcs] * backward[e, w] * np.exp(scale[s, w] - scale[e, w])
                np.add.at(backward[s], w, value)
            share = forward[start, word] * weight * backward[end, word] * np.exp(scale[start, word] - scale[end, word])
            share = (share / forward[-1, word])[:, 0] * np.asarray(n)[at][word]
            known = ids < len(self.p)
            out += np.bincount(ids[known], share[known], len(self.p))
            for k, pieces in enumerate(spelt):
                np.add.at(out, pieces, share[ids == len(self.p) + k].sum())
        return out


def _table(found, langs: list[str], n_pieces: int):
    import numpy as np

    table = np.zeros((n_pieces, len(langs)))
    table[found["piece"], [langs.index(x) for x in found["lang"]]] = found["n"]
    return table


def train(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", lang_col: str = "lang", text_col: str = "text", passes: int = PASSES) -> Model:
    """Piece probabilities of all languages from all texts with a language.

    Tasks count distinct words, whose counts are added up for the corpus, so a hot language is only more sums and
    each word is looked at once. Counts start from one segmentation of each word; each pass then takes the expected
    counts over all segmentations. The driver gets one number for each piece and language.
    """
    import sentencepiece

    path, spark = vocabulary_path(vocabulary), docs.sparkSession
    n_pieces = sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
    scratch = Scratch(spark, "language")
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    words = rows.mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = scratch.save(words, "words")
    adding = lambda counted: words.mapInArrow(counted, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    found = adding(_one_segmentation(path))
    langs = sorted(found["lang"].unique())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    model = Model(langs, _table(found, langs, n_pieces), path)
    for _ in range(passes if langs else 0):
        shared = spark.sparkContext.broadcast(model)
        model = Model(langs, _table(adding(_all_segmentations(shared)), langs, n_pieces), path)
        shared.unpersist()
    scratch.drop("words")
    return model


class _Ids(dict):
    """Numbers words as they are first looked up."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _predict(model, least: float | None = None):
    """Batches of (id, text, ...) to predictions, or, with `least`, to the rows that are told with this score or more."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        m = model.value.open()
        memo, rows, most = _Ids(), np.zeros((0, len(m.langs))), min(MEMO, 4_000_000 // max(1, len(m.langs)))

        def sums(texts: list[list[str]]):
            """Log probabilities of texts, each with a word: words of many texts are scored together, each once."""
            nonlocal rows
            if len(memo) > most:
                memo.clear()
                rows = rows[:0]
            at = np.array([memo[w] for words in texts for w in words])
            new = [w for w, _ in zip(reversed(memo), range(len(memo) - len(rows)))][::-1]
            if new:
                rows = np.concatenate([rows, m.score(new)])
            return np.add.reduceat(rows[at], np.cumsum([0, *map(len, texts[:-1])]))

        for batch in batches:
            n = batch.num_rows
            langs, scores = ["und"] * n, [0.0] * n
            for at, texts in _runs(batch.column(1)) if m.langs else ():
                x = sums(texts)
                best = x.argmax(1)
                share = 1 / np.exp(x - x.max(1, keepdims=True)).sum(1)
                for j, b, s in zip(at, best.tolist(), share.tolist()):
                    langs[j], scores[j] = m.langs[b], s
            if least is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])
            else:
                yield batch.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row: the language under which the text is likeliest, languages taken as
    equally likely, and its posterior probability.

    A null text, or one without letters, is `und` with score 0; so is every text when no language was learned. Of
    equally likely languages the first by code point is taken. Texts and words are scored whole, however long; repeated
    rows and ids are rows of their own, an empty table gives no rows. A letter outside the vocabulary weighs what its
    UTF-8 bytes' pieces weigh. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose language is told with a score of `least` or more; `und` goes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(id_col, text_col, *others)
    return rows.mapInArrow(_predict(shared, least), rows.schema).select(*docs.columns)


def held_out(doc_id: Column) -> Column:
    """The third that is never learned from; a null id isn't in it."""
    return F.coalesce(crc_bucket(doc_id, 3) == 1, F.lit(False))


def train_on_fold(docs: DataFrame, id_col: str = "doc_id") -> Model:
    return train(docs.where(crc_bucket(F.col(id_col), 3) != 1))
