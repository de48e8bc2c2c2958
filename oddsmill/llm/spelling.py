"""Spelling variants: words at one inserted, deleted or replaced letter from a far more frequent one.

Within a cell of the vocabulary, a set of words is the bits of a number, and an index has one set for each position and
letter. A query word is read letter by letter; four such numbers, moved on by `&`, `|` and `~` for all words of the cell
at once, hold the words equal so far (no error) and those with one letter replaced, added or missing (one error, read
at the same, the next or the previous position).
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, growing

#: Letters of a word: ASCII letters and U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]+"
#: Code points and occurrences that a word has at least.
MIN_LETTERS, MIN_COUNT = 6, 5
#: A form occurs at least this many times as often.
RATIO = 5
#: Words of a cell; larger cells are cut by longer keys.
CELL_WORDS = 4096
FOUND = "word string, n_near long, form string, form_n long"


def damaged(doc_id: Column, run: Column, one_in: int = 199) -> Column:
    """The run, or, where the crc32 of `<doc_id>:<run>` is a multiple of one_in, the run without one of its letters."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, one_in: int = 199, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of the whole texts with their numbers of occurrences: (word, n)."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    runs = F.filter(F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(1)), lambda r: F.length(r) >= min_letters)
    d = docs.select(F.col(id_col).alias("doc_id"), runs.alias("runs")).select("doc_id", F.explode("runs").alias("run"))
    words = d.select(damaged(F.col("doc_id"), F.col("run"), one_in).alias("word")).where(F.length("word") >= min_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _keys(a: Column, b: Column, shorter: Column, word: Column) -> Column:
    """What two words share whose one difference lies at positions a to b of the shorter one."""
    tail = F.length(word) - (shorter - b)
    return F.concat_ws("\u0000", shorter.cast("string"), a.cast("string"), b.cast("string"), F.substring(word, F.lit(1), a), F.substring(word, (tail + 1).cast("int"), F.length(word)))


def cells(words: DataFrame, scratch: Scratch, bound: int = CELL_WORDS) -> DataFrame:
    """(shorter, a, b, cell, word, n): any two words at one edit are together in one cell or more.

    A pair whose shorter word has L letters agrees in all letters before the difference and after it. So a word of m
    letters stands in cells of L = m and L = m - 1, by the letters outside the first and outside the second half.
    Where over `bound` words share a cell, the half is halved again, down to one position; such a cell has at most
    one word for each letter, or pair of letters, of the alphabet.
    """
    m = F.length("word")
    shorter = F.explode(F.array(m, m - 1)).alias("shorter")
    c = words.select("word", "n", shorter).where("shorter > 0")
    half = F.floor(F.col("shorter") / 2).cast("int")
    windows = F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), F.col("shorter").alias("b")))
    c = c.select("word", "n", "shorter", F.explode(windows).alias("w")).select("word", "n", "shorter", "w.a", "w.b").where("a < b")
    keyed = lambda df: df.withColumn("cell", _keys(F.col("a"), F.col("b"), F.col("shorter"), F.col("word")))
    open_, done, k = keyed(c), None, 0
    while True:
        open_ = scratch.save(open_, f"open-{k}")
        sizes = open_.groupBy("cell").agg(F.count("*").alias("_words"), F.max(F.col("b") - F.col("a")).alias("_width"))
        large, n_large, _ = scratch.save_counted(sizes.where((F.col("_words") > bound) & (F.col("_width") > 1)).select("cell"), f"large-{k}")
        ready = open_.join(growing(large), "cell", "left_anti") if n_large else open_
        done = ready if done is None else done.unionByName(ready)
        if n_large == 0:
            return done
        again = open_.join(growing(large), "cell", "left_semi")
        mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.array(F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b").alias("b")))
        again = again.select("word", "n", "shorter", F.explode(halves).alias("w")).select("word", "n", "shorter", "w.a", "w.b")
        open_, k = keyed(again), k + 1


def near_sets(words: list[str], shorter: int, a: int, b: int) -> Iterator[tuple[int, int]]:
    """For each word of a cell that has any, (its place, the set of words at one edit) as bits of a number.

    The words have shorter or shorter + 1 letters and agree outside the window. A difference counts where it is met
    first, at positions a to b (and after the last letter, where b is the end), so that two cells never give one pair.
    """
    index: dict[tuple[int, str], int] = {}
    of_length = {shorter: 0, shorter + 1: 0}
    for k, w in enumerate(words):
        bit = 1 << k
        of_length[len(w)] |= bit
        for i in range(a, min(len(w), b + 1)):
            index[i, w[i]] = index.get((i, w[i]), 0) | bit
    everything = (1 << len(words)) - 1
    short, long = of_length[shorter], of_length[shorter + 1]
    for k, w in enumerate(words):
        if len(w) == shorter:
            # equal so far; one letter of w replaced; one letter more than w, read one place further
            zero, replaced, added = everything & ~(1 << k), 0, 0
            for i in range(a, b):
                here, there = index.get((i, w[i]), 0), index.get((i + 1, w[i]), 0)
                first = zero & ~here
                replaced = replaced & here | first & short
                added = (added | first & long) & there
                zero &= here
                if not zero | replaced | added:
                    break
            if b == shorter:
                added |= zero & long
            found = replaced & short | added & long
        else:
            # one letter of w missing, read one place earlier
            zero, missing = everything & ~(1 << k) & short, 0
            for i in range(a, b):
                here = index.get((i, w[i]), 0)
                missing = missing & index.get((i - 1, w[i]), 0) if i > a else 0
                missing |= zero & ~here
                zero &= here
                if not zero | missing:
                    break
            # the letter after the window stands at its last place in the shorter words
            missing = missing & index.get((b - 1, w[b]), 0)
            if b == shorter:
                missing |= zero
            found = missing
        if found:
            yield k, found


def _search(batches: Iterator) -> Iterator:
    import pyarrow as pa

    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])
    for batch in batches:
        out: list[tuple[str, int, str, int]] = []
        for row in batch.to_pylist():
            ranked = sorted((-x["n"], x["word"]) for x in row["members"])  # the first bit is the best form
            words = [w for _, w in ranked]
            for k, found in near_sets(words, row["shorter"], row["a"], row["b"]):
                best = (found & -found).bit_length() - 1
                out.append((words[k], found.bit_count(), words[best], -ranked[best][0]))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], schema.field(j).type) for j in range(4)], schema=schema)


def variants(words: DataFrame, ratio: int = RATIO, bound: int = CELL_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n) of distinct words.

    n_near counts the other words at exactly one inserted, deleted or replaced code point; form is the one of them with
    the largest n (ties: the smallest in code-point order) where that is at least `ratio` times the word's, else null;
    root is where the forms of forms end, the word itself where it has none. Null words are left out, words may have
    any length, an empty table gives no rows.

    Plan: words meet in cells by what a pair at one edit must share, at most four cells a word; a cell of over `bound`
    words is cut, so a task never holds more than a few thousand words of one. A cell gives at most one row a word
    (its count and its best), never its pairs; sums by word follow. Chains of forms grow by `ratio` each step, so
    they are followed by doubling in a few joins.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    try:
        words, _, _ = scratch.save_counted(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
        c = cells(words, scratch, bound)
        members = c.groupBy("cell", "shorter", "a", "b").agg(F.collect_list(F.struct("n", "word")).alias("members")).where(F.size("members") > 1)
        found = members.select("shorter", "a", "b", "members").mapInArrow(_search, FOUND)
        top = F.min_by("form", F.struct((-F.col("form_n")).alias("m"), "form"))
        near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("form"), F.max("form_n").alias("form_n"))
        joined = words.join(growing(near), "word", "left")
        often = F.col("form_n") >= ratio * F.col("n")
        table = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("form")).alias("form"), F.when(often, F.col("form_n")).alias("form_n"))
        table = scratch.save(table, "table")
        links = table.where("form is not null").select("word", F.col("form").alias("root"))
        most = table.agg(F.max("n")).first()[0] or 1
        steps = max(1, int(math.log(most, ratio)) + 1)
        for k in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
            links = scratch.save(links, f"links-{k}")
            on = links.select(F.col("word").alias("_mid"), F.col("root").alias("_end"))
            links = links.join(growing(on), F.col("root") == F.col("_mid"), "left").select("word", F.coalesce("_end", "root").alias("root"))
        out = table.join(growing(links), "word", "left").withColumn("root", F.coalesce("root", "word"))
        return scratch.save(out.select("word", "form", "root", "n", "n_near", "form_n"), "result")
    finally:
        scratch.drop_but("result")


def group_spellings(docs: DataFrame, one_in: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`variants` of the words of whole texts: (word, form, root, n, n_near, form_n).

    Words are maximal runs of RUN with A to Z lower-cased, of at least 6 code points and 5 occurrences; one in 199 runs,
    by a checksum of its document's id and itself, loses a letter first. Null texts have no words, a null id counts as
    an empty one, repeated rows count each, and texts and words of any length are taken whole. Columns beside the two
    named ones are ignored, whatever their names; an empty table gives no rows.
    """
    return variants(vocabulary(docs, one_in, id_col=id_col, text_col=text_col))
