"""Benchmark passages, Merkle manifests and ranked search against brute force, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import catalog, contamination, merkle, ranked

LOWER = {k: k + 32 for k in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


# --- benchmark passages ------------------------------------------------------

def plain_windows(items, size=10):
    out = set()
    for name, text in items:
        w = words(text)
        out |= {("" if name is None else str(name), tuple(w[k:k + size])) for k in range(max(len(w) - size + 1, min(len(w), 1)))}
    return out


def plain_find(text, windows):
    w = words(text)
    hit, held = set(), set()
    for name, window in windows:
        for k in range(len(w) - len(window) + 1):
            if tuple(w[k:k + len(window)]) == window:
                hit |= set(range(k, k + len(window)))
                held.add(name)
    runs = []
    for k in sorted(hit):
        if runs and sum(runs[-1]) == k:
            runs[-1][1] += 1
        else:
            runs.append([k, 1])
    return len(w), [tuple(r) for r in runs], sorted(held)


def passages(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["Über", "日本", "9a"]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(n))) for k, n in enumerate([3, 1, 2, 9, 10, 11, 30, 30, 25])]
    items[1] = (1, "solo")
    items += [(20, items[6][1]), (6, " ".join(some(14))), (None, " ".join(some(12))), (21, None), (22, ""), (23, " .-! "), (24, "a" * 3000 + " b")]
    texts = [None, "", " .,;", "solo", "SOLO!solo", "w1", "a" * 3000 + "-B " + "a" * 3001 + " b"]
    for _ in range(60):
        parts = some(r.randrange(1, 60))
        for _ in range(r.randrange(3)):
            source = words(r.choice(items)[1])
            at = r.randrange(len(source) + 1)
            parts += source[at:at + r.randrange(1, 15)] + some(r.randrange(4))
        texts.append(r.choice([" ", ", ", "\n"]).join(parts).upper() if r.random() < 0.3 else " ".join(parts))
    texts += [texts[-1], " ".join(words(items[6][1]) * 400)]
    return items, texts


@pytest.mark.parametrize("block_bytes", [contamination.BLOCK_BYTES, 600])
def test_windows_equal_brute_force(spark, block_bytes):
    items, texts = passages(5)
    rows = [(None if k == 9 else min(k, len(texts) - 2), t, "clash", 2.5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tkey string, spans double").repartition(3)
    known = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, item string")
    windows = plain_windows(items)
    got = sorted(((x["id"], x["n_words"], [tuple(s) for s in x["spans"]], x["items"])
                  for x in contamination.find_windows(docs, known, block_bytes=block_bytes).collect()), key=str)
    assert got == sorted(((i, *plain_find(t, windows)) for i, t, *_ in rows), key=str)


def test_windows_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    none = spark.createDataFrame([], "id long, text string")
    assert contamination.find_windows(none, docs).collect() == []
    assert [tuple(x) for x in contamination.find_windows(docs, none).collect()] == [(1, 2, [], [])]


def test_search_skips_and_compares_bytes():
    r = random.Random(1)
    windows = contamination.Windows([" ".join(f"x{r.randrange(1000)}" for _ in range(10)) for _ in range(50)], ["i"] * 50)
    search = windows.searches[0]
    value = np.array([r.getrandbits(64) for _ in range(20_000)], np.uint64)
    assert len(search._ends(value, np.array([0, 20_000]))) < 200  # most blocks are in no window
    assert (search.shift == search.size - search.block + 1).mean() > 0.9


# --- Merkle manifests --------------------------------------------------------

def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row)


def plain_tree(nodes):
    """The root, and per node the siblings from below upward."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][k:k + 8]) for k in range(0, len(levels[-1]), 8)])
    proofs = []
    for k in range(len(nodes)):
        proof, at = [], k
        for level in levels[:-1]:
            low = at // 8 * 8
            proof.append((at - low, [x for j, x in enumerate(level[low:low + 8]) if j != at - low]))
            at //= 8
        proofs.append(proof)
    return levels[-1][0], proofs


def plain_manifest(rows):
    groups = {}
    for row in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, plain_leaf(x))):
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([plain_leaf(x) for x in groups[g]]) for g in names}
    root, outer = plain_tree([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, outer):
        for row, proof in zip(groups[g], trees[g][1]):
            found = row if row[0] is None or zlib.crc32(str(row[0]).encode()) % 3 or row[4] is None else (*row[:4], row[4].translate(LOWER))
            node, proof = plain_leaf(found), proof + above
            for place, others in proof:
                node = h([*others[:place], node, *others[place:]])
            out.append((row[0], plain_leaf(row), trees[g][0], root, h(x for _, o in proof for x in o), node, node == root))
    return out


def manifest_rows(n, seed=2):
    r = random.Random(seed)
    langs = ["en"] * 12 + ["de", "fr", None, "", "ñ", "zz"]
    rows = [(k * 3, r.choice(["s", None]), r.choice(langs), r.choice([None, 5]), r.choice(["Ab é", "", None, "plain", "x" * 50])) for k in range(n)]
    rows += [(None, "a", "en", 1, "Null Id"), rows[0], (rows[1][0], "twin", rows[1][2], 1, "Other"), (7, "s", "alone", 1, "Alone")]
    r.shuffle(rows)
    return rows


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n, levels", [(700, 1), (5000, 4)])
def test_manifest_equals_brute_force(spark, n, levels):
    rows = manifest_rows(n)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    leaves = docs.withColumn("leaf", merkle.leaf("doc_id", "source", "lang", "n_chars", "text"))
    changed = merkle.leaf("doc_id", "source", "lang", "n_chars", F.translate("text", upper, upper.lower()))
    found = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, changed).otherwise(F.col("leaf"))
    made = merkle.manifest(leaves.select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), "leaf", found.alias("found"),
                                         F.lit(1).alias("tree"), F.lit("x").alias("_part")), proofs=True, levels=levels).collect()
    assert sorted((tuple(x)[:6] + (x["verified"],) for x in made), key=str) == sorted(plain_manifest(rows), key=str)
    for x in made[:200]:
        proof = [(p["place"], p["others"]) for p in x["proof"]]
        assert merkle.fold(x["leaf"], proof) == x["root"]
    assert 0 < sum(not x["verified"] for x in made) < len(made)


def test_manifest_of_nothing_and_of_one_row(spark):
    schema = "id string, group string, leaf string, found string"
    assert merkle.manifest(spark.createDataFrame([], schema)).collect() == []
    x, = merkle.manifest(spark.createDataFrame([("a", None, "11", "12")], schema)).collect()
    assert tuple(x) == ("a", "11", "11", "11", h([]), "12", False)


# --- ranked search -----------------------------------------------------------

def plain_search(docs, items, top=10):
    terms = [(i, words(t)) for i, t in docs]
    nn, ll = sum(bool(w) for _, w in terms), sum(len(w) for _, w in terms)
    df = Counter(x for _, w in terms for x in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, w in terms:
            if w:
                m, tf = 10 + 90 * len(w) * nn // ll, Counter(w)
                score = sum(math.floor(1000 * math.log((2 * nn + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in wanted)
                if score > 0:
                    scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def search_rows(seed=3):
    r = random.Random(seed)
    vocabulary = [f"T{k}" for k in range(40)] + ["é", "日", "common"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + r.choice(["", " common", "!"])
    docs = [(k, text(r.randrange(1, 40))) for k in range(150)]
    docs += [(None, "t1 t2 T3"), (200, None), (201, ""), (202, "..."), (203, "T1 " * 5000), (204, docs[0][1]), (0, docs[0][1]), (205, docs[0][1])]
    items = [(k, text(r.randrange(1, 30))) for k in range(20)] + [(30, "common"), (31, "absent words"), (32, None), (33, "..."), (None, "t1"), (3, "t5 t6")]
    return docs, items


@pytest.mark.parametrize("block_terms", [ranked.BLOCK_TERMS, 40])
def test_search_equals_brute_force(spark, block_terms):
    docs, items = search_rows()
    table = spark.createDataFrame([(*x, 1, "n") for x in docs], "doc_id long, text string, n int, item string").repartition(4)
    known = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, terms string")
    got = sorted((tuple(x) for x in ranked.search(table, known, block_terms=block_terms).collect()), key=str)
    assert got == plain_search(docs, items)


def test_search_of_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([], "id long, text string")
    assert ranked.search(none, some).collect() == ranked.search(some, none).collect() == ranked.search(none, none).collect() == []


@pytest.mark.parametrize("mined", [2, 64])
def test_shared_sums_reach_every_term_once(mined):
    r = random.Random(6)
    groups = [r.sample(range(100), 12) for _ in range(4)]
    items = [sorted(set(sum(r.sample(groups, 2), []) + r.sample(range(100), 6))) for _ in range(60)] + [[], [7]]
    sums, used = ranked.shared_sums(items, mined)
    base = max(max(x, default=0) for x in items) + 1

    def leaves(node):
        return [node] if node < base else [x for n in sums[node - base] for x in leaves(n)]

    assert [sorted(x for n in nodes for x in leaves(n)) for nodes in used] == items
    assert all(n < base + k for k, nodes in enumerate(sums) for n in nodes)
    additions = sum(len(x) - 1 for x in sums) + sum(max(len(x) - 1, 0) for x in used)
    assert additions < sum(max(len(x) - 1, 0) for x in items)


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_merkle_manifest", "op13_ranked_search"])
def test_query_equals_sql(spark, name):
    from tools.compare import compare, connect
    good, note, _ = compare(spark, connect("/root/testdata/sf0.001"), "/root/testdata/sf0.001", name)
    assert good and name in catalog.ORACLES, note
