"""Quality rules as a ledger: every rule is evaluated once, its bit and measurements kept, and policies read the bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Rules by bit: what fails, over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "2 * n_symbols > 3 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 7 * n_lines and n_dup_lines >= 3"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
)
#: Policies by version: the rules that decide.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
}


def mask(*names: str) -> int:
    bits = {name: 1 << k for k, (name, _) in enumerate(RULES)}
    return sum(bits[n] for n in names)


def _twice(windows: Column) -> Column:
    """Places of the 3-word windows that occur twice or more, in order: sorted windows show equal neighbours."""
    at = lambda i: F.get(windows, i)["w"]
    marked = F.transform(windows, lambda x, i: F.struct(x["i"].alias("i"), ((i > 0) & (at(i - 1) == x["w"]) | F.coalesce(at(i + 1) == x["w"], F.lit(False))).alias("twice")))
    return F.sort_array(F.transform(F.filter(marked, lambda x: x["twice"]), lambda x: x["i"]))


def _covered(starts: Column) -> Column:
    """Words under windows of three at these places."""
    gaps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: measurements and `failed`, a bit for each rule of RULES.

    Null texts count as empty; empty texts have no words and fail few_words. Texts are taken whole, rows one by
    one (repeats and null ids stay), and no other column is read. Everything is a built-in expression on the
    row: nothing is shuffled, however large a group of copies is. An empty table gives no rows.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    d = d.select("doc_id", "_t", F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    size = F.size("_words")
    windows = F.transform(F.slice("_words", 1, F.greatest(size - 2, F.lit(0))), lambda w, i: F.struct(F.concat_ws(" ", w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("w"), i.alias("i")))
    d = d.select("doc_id", "_t", "_words", "_lines", F.sort_array(windows).alias("_windows"))
    d = d.select("doc_id", "_t", "_words", "_lines", _twice(F.col("_windows")).alias("_starts"))
    d = d.select(
        "doc_id",
        size.cast("long").alias("n_words"),
        F.char_length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_starts")).alias("n_repeat_words"),
    )
    bits = [F.when(F.expr(rule), 1 << k).otherwise(0) for k, (_, rule) in enumerate(RULES)]
    return d.withColumn("failed", sum(bits[1:], bits[0]).cast("int"))


def verdict(failed: Column, policy: str) -> Column:
    """Whether a policy keeps a row with these bits."""
    return failed.bitwiseAND(mask(*POLICIES[policy])) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows it fails, rows only it fails, rows kept without it.

    The ledger is first folded to counts by mask (at most 2 to the number of rules rows, summed map-side); bit
    arithmetic on those gives every ablation without another look at the texts.
    """
    all_bits = mask(*POLICIES[policy])
    folded = book.groupBy(F.col("failed").bitwiseAND(all_bits).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask(r)).alias("bit")) for r in POLICIES[policy]]))
    each = folded.select("m", "n", rules.alias("r")).select("m", "n", "r.rule", "r.bit")
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    none = F.lit(0).cast("long")
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(none)).alias("n_failed"),
        F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(none)).alias("n_failed_alone"),
        F.sum(F.when(F.col("m").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(none)).alias("n_kept_without"),
    )
