"""The numbered queries: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, language_id, ledger_sql, lm_scoring, merkle, minhash_forest, mixing, packing, passage_chains, quality_rules, sharding, spelling, suffix_dedup, token_counts


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(_read(spark, sf_dir, "embeddings"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(_read(spark, sf_dir, "documents"))
    kept = quality_rules.verdict
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~kept(F.col("failed"), "base")).alias("base_failed"), kept(F.col("failed"), "v1").alias("kept"))


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def op6_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(_read(spark, sf_dir, "documents"), size=3, percent=85)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train_on_fold(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_chains.shared_passages(_read(spark, sf_dir, "documents"))


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    m = merkle.manifest(_read(spark, sf_dir, "documents"), tampered, changed={"n_chars": F.col("n_chars") + 1})
    folded = merkle.fold(F.coalesce("altered", "leaf"), F.col("turns"), F.col("siblings"))
    m = m.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(_read(spark, sf_dir, "documents"))


def op13_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version does: rows that it fails, that only it fails, and that are kept without it."""
    book = quality_rules.ledger(_read(spark, sf_dir, "documents"))
    parts = [quality_rules.ablations(book, p).select(F.lit(p).alias("policy"), "*") for p in quality_rules.POLICIES]
    return parts[0].unionByName(parts[1])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_quality_rules": op5_quality_rules,
    "op6_minhash_forest": op6_minhash_forest,
    "op7_language_id": op7_language_id,
    "op8_passage_chains": op8_passage_chains,
    "op9_pattern_packing": op9_pattern_packing,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_bounded_ring": op13_bounded_ring,
    "quality_ablations": quality_ablations,
}

ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": ledger_sql.MANIFEST,
    "op12_spelling_variants": ledger_sql.SPELLING,
    "op5_quality_rules": r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (
  select doc_id, t,
    regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words,
    [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines
  from d
),
win as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)
),
twice as (select doc_id, i, count(*) over (partition by doc_id, g) as n from win),
rep as (
  select doc_id, count(distinct j) as n
  from (select doc_id, unnest([i, i + 1, i + 2]) as j from twice where n > 1)
  group by doc_id
),
m as (
  select w.doc_id, len(words)::bigint as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(rep.n, 0)::bigint as n_repeat_words
  from w left join rep on w.doc_id = rep.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 2 * n_symbols > 3 * n_words
    or (10 * n_dup_lines > 7 * n_lines and n_dup_lines >= 3) or word_chars < 2 * n_words or word_chars > 40 * n_words) as kept
from m
""",
}

_RULES = {
    "few_words": "n_words < 50", "repeated_windows": "100 * n_repeat_words > 50 * n_words", "symbols": "2 * n_symbols > 3 * n_words",
    "repeated_lines": "10 * n_dup_lines > 7 * n_lines and n_dup_lines >= 3", "short_words": "word_chars < 2 * n_words", "long_words": "word_chars > 40 * n_words",
}
_measured = ORACLE_SQL["op5_quality_rules"].rsplit("select doc_id, n_words, word_chars", 1)[0]


def _ablation(policy: str) -> str:
    names = quality_rules.POLICIES[policy]
    none = lambda skip: " and ".join(["true", *(f"not ({_RULES[r]})" for r in names if r != skip)])
    return " union all ".join(f"select '{policy}' as policy, '{r}' as rule, count(*) filter (where {_RULES[r]}) as n_failed, count(*) filter (where {_RULES[r]} and {none(r)}) as n_failed_alone, count(*) filter (where {none(r)}) as n_kept_without from m" for r in names)


ORACLE_SQL["quality_ablations"] = _measured + " union all ".join(map(_ablation, quality_rules.POLICIES))
