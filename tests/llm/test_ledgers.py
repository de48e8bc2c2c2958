"""The manifest, the spelling groups and the ring against brute force, odd rows and hot keys included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from oddsmill.llm import merkle, sharding, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos long, n long, hash string, word string, cell int, sub int, size long, uid long, shard int, spot long, block long"


def make_rows():
    rng = random.Random(11)
    langs = ["en"] * 40 + ["fr"] * 9 + ["", None, "zß", "de"]
    words = ["elephant", "elephants", "ellephant", "elefant", "Éléphant", "éléphant", "planet", "planets", "plannet", "abcdef", "bcdefa", "aabcdef", "xabcdef", "abcdefg", "ab×cd÷e"]
    rows = []
    for k in range(190):
        text = None if k % 23 == 7 else "" if k % 23 == 8 else " ".join(rng.choices(words, weights=[40, 20, 3, 3, 2, 9, 60, 9, 3, 30, 5, 5, 3, 5, 9], k=rng.randint(1, 30)))
        rows.append((k, text, rng.choice(langs), None if k % 11 == 0 else f"s{k % 3}", None if k % 13 == 0 else len(text or "")))
    rows += [(None, "planet planet 9", "en", "s1", 3), (None, None, None, None, None), (5000, "q" * 70_000 + " " + "z" * 9_000, "fr", "s2", 1)]
    rows += [rows[3]] * 5 + [(7, "hot key " * (k % 4), "en", "s0", 2) for k in range(150)]
    rows = [(*r, "k", 1, 2, "h", "w", 3, 4, 5, 6, 7, 8, 9) for r in rows]
    rng.shuffle(rows)
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n = row[:5]
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(one, (doc_id, source, lang, None if n is None else n + more, text))))


def climb(nodes):
    """Root of a list of digests, and the proof of each: (left siblings or right, digest) from below."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for p, k in zip(proofs, at):
            if (k ^ 1) < len(level):
                p.append(("R" if k % 2 == 0 else "L", level[k ^ 1]))
            else:
                p.append(("-", ""))
        level = [sha("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
        at = [k // 2 for k in at]
    return level[0], proofs


def manifest_by_hand(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        own[lang] = climb([leaf(r) for r in by_lang[lang]])
    root, above = climb([own[x][0] for x in langs])
    out = []
    for lang, upper in zip(langs, above):
        for r, lower in zip(by_lang[lang], own[lang][1]):
            proof, bad = lower + upper, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, int(bad))
            for turn, s in proof:
                h = sha(h + s if turn == "R" else s + h)
            out.append((r[0], leaf(r), own[lang][0], root, sha("".join(s for _, s in proof)), h, h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_levels", [2, 10])
def test_manifest_equals_brute_force(docs, block_levels):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    m = merkle.manifest(docs, tampered, changed={"n_chars": F.col("n_chars") + 1}, block_levels=block_levels)
    folded = merkle.fold(F.coalesce("altered", "leaf"), F.col("turns"), F.col("siblings"))
    got = m.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256), folded.alias("f"), (folded == F.col("root")).alias("v")).collect()
    want = manifest_by_hand(ROWS)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {w[6] for w in want} == {True, False}


def test_manifest_of_few_rows(spark, empty):
    assert merkle.manifest(empty).count() == 0
    one = spark.createDataFrame(ROWS[:1], SCHEMA)
    r = merkle.manifest(one).first()
    assert r.leaf == r.subroot == r.root == leaf(ROWS[0]) and r.turns == r.siblings == ""


def test_a_hot_language_is_many_tasks(spark):
    """No task of the numbering reads a whole key: rows go by ranges of (key, id)."""
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("en").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    scratch = merkle.Scratch(spark, "test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = merkle.numbered(d, "key", ["doc_id"], scratch, "x").collect()
    assert sorted((r.pos, r.doc_id, r.n) for r in got) == [(k, k, 4000) for k in range(4000)]
    assert spark.read.parquet(f"{scratch.root}/x-runs").count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    scratch.drop_but()


def words_by_hand(rows, one_in):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def variants_by_hand(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), None if form[w] is None else n[form[w]]) for w in n)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("one_in", [199, 7])
def test_spelling_equals_brute_force(docs, empty, one_in):
    want = variants_by_hand(words_by_hand(ROWS, one_in))
    assert sorted_rows(spelling.group_spellings(docs, one_in)) == sorted(want, key=repr)
    assert len(want) > 8 and any(w[1] for w in want)
    assert spelling.group_spellings(empty).count() == 0


@pytest.mark.parametrize("bound", [1, 3, 20, 4096])
def test_variants_over_few_letters(spark, bound):
    """All short words over two or three letters: runs of equal letters, every edit place, cells cut to the end."""
    rng = random.Random(bound)
    n = {"".join(rng.choices("ab", k=rng.randint(1, 7))): rng.choice([1, 5, 5, 26, 130, 700]) for _ in range(150)}
    n |= {"".join(rng.choices("abé", k=rng.randint(6, 9))): rng.choice([5, 26, 700]) for _ in range(80)}
    n |= {"x" * 400: 5, "x" * 401: 30, "x" * 200 + "y" + "x" * 200: 200, "x" * 399 + "y": 1100}
    assert sorted_rows(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), bound=bound)) == sorted(variants_by_hand(n), key=repr)


def ring_by_hand(rows, n_shards, nodes, slack, cells, heavy):
    """Owner of every byte, one by one: the ring walked with a list of single bytes."""
    xxhash = pytest.importorskip("xxhash")
    spot = lambda i: (lambda h: h - (1 << 64) if h >= 1 << 63 else h)(xxhash.xxh64(("null" if i is None else str(i)).encode(), seed=42).intdigest())
    sized = [(spot(r[0]) % cells, spot(r[0]), r[0], len((r[1] or "").encode()) + 16) for r in rows]
    total = sum(r[3] for r in sized)
    cap, least = math.ceil((1 + slack) * total / n_shards), max(1, math.ceil(total / (n_shards * heavy)))
    at = sharding.ring(n_shards, nodes, cells)
    tokens = sorted(at)
    clockwise = lambda c: [at[t] for t in sorted(tokens, key=lambda t: (t < c, t))]
    load, got = Counter(), []
    for c, s, i, size in sorted((r for r in sized if r[3] >= least), key=lambda r: (-r[3], r[1], r[2] is not None, r[2] or 0)):
        shard = next((x for x in clockwise(c) if load[x] + size <= cap), None)
        if shard is None:
            shard = min(range(n_shards), key=lambda x: (load[x], x))
        load[shard] += size
        got.append((i, size, shard))
    queue, late = [], defaultdict(list)
    for c, s, i, size in sorted((r for r in sized if r[3] < least), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0)):
        shard = clockwise(c)[0]
        for byte in range(size):
            if load[shard] < cap:
                load[shard] += 1
                if byte == 0:
                    got.append((i, size, shard))
            else:
                late[c].append((i, size, byte))
    for turn in range(2):
        for c in range(cells):
            queue += late[c] if turn == 0 else []
            while c in at and queue and load[at[c]] < cap:
                i, size, byte = queue.pop(0)
                load[at[c]] += 1
                if byte == 0:
                    got.append((i, size, at[c]))
    return sorted(got, key=repr)


def test_ring_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(None if k == 9 else k * 17, "é" * rng.randint(0, 60) if k % 7 else None) for k in range(200)] + [(9, "x" * 1500), (10, "x" * 6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n, heavy in ((4, 16), (5, 4)):
        got = sharding.assign(d, n, nodes=5, slack=0.02, cells=64, heavy=heavy, hot=1)
        want = ring_by_hand(rows, n, 5, 0.02, 64, heavy)
        assert sorted(((r.doc_id, r.size, r.shard) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("hot", [64, 2])
def test_shards_are_whole_and_gapless(docs, empty, hot):
    got = sharding.assign(docs, 7, hot=hot, cells=1024, subs=16).collect()
    key = lambda r: (r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()))
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(map(key, ROWS), key=repr)
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.assign(empty, 7).count() == 0


def test_shards_are_near_equal_with_a_hot_key_and_few_rows_move(spark):
    d = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("doc_id"), F.expr("repeat('x', int(id % 97))").alias("text"))
    sizes = [r.bytes for r in sharding.shard_sizes(sharding.assign(d, 10, subs=64)).collect()]
    mean = sum(sizes) / 10
    assert max(sizes) < 1.02 * mean and min(sizes) > 0.95 * mean
    unique = d.where("doc_id >= 0")
    m = sharding.moved(sharding.assign(unique, 10), sharding.assign(unique, 11)).first()
    assert m.all_rows == 4000 and m.bytes < 0.45 * m.all_bytes
