"""Near-duplicate operators against brute force, with awkward rows."""

import random
import re
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import caps, minhash, substrings, wordhash
from corpusgraph.llm.components import UnionFind, components


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def least_ids(ids, pairs):
    sets = UnionFind()
    for a, b in pairs:
        sets.union(a, b)
    least = {}
    for k, i in enumerate(ids):
        root = sets.find(k)
        if i is not None:
            least[root] = min(i, least.get(root, i))
    return [least.get(sets.find(k)) for k in range(len(ids))]


def family(r, size, words, edits):
    base = [f"w{r.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(r.randrange(edits + 1)):
            own[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_minhash_groups_equal_brute_force(spark):
    r = random.Random(4)
    texts = [None, "", " \n\t ", "one two", "ONE two", "a b c d e", "A B c d e", "long " * 30000 + "end here now and then"]
    texts += family(r, 60, 120, 6) + family(r, 20, 200, 12) + family(r, 10, 40, 1) + ["same text of seven words in all"] * 5
    texts += [" ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(1, 80))) for _ in range(60)]
    r.shuffle(texts)
    rows = [(None if k == 3 else k, t, "clash", 1.5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n double").repartition(5)
    got = {(x["id"]): x for x in minhash.near_duplicates(docs).collect()}
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = least_ids([x[0] for x in rows], pairs)
    assert len(got) == len(rows)
    for (i, *_), s, component in zip(rows, sets, want):
        assert got[i]["n_shingles"] == len(s)
        assert got[i]["component_id"] == component
        assert got[i]["kept"] == (i == component or (i is None and component is None))


def test_minhash_of_nothing_and_of_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == []
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "z")], "doc_id long, text string")
    rows = sorted((x["id"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(twice).collect())
    assert rows == [(1, 1, True), (1, 1, True), (2, 2, True)]


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(3)
    errors = []
    for size in (5, 40, 400, 3000):
        for _ in range(10):
            both = r.integers(0, 2**63, size, dtype=np.uint64)
            own = [r.integers(0, 2**63, size // 4, dtype=np.uint64) for _ in range(2)]
            sets = [np.unique(np.concatenate([both, x])) for x in own]
            value, offsets = np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
            a, b = minhash.superminhash(value, offsets)
            errors.append((a == b).mean() - size / (size + 2 * (size // 4)))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_large_families_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FAMILY_SHINGLES", 300)
    r = random.Random(9)
    texts = family(r, 80, 60, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["id"]: x["component_id"] for x in minhash.near_duplicates(docs).collect()}
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert [got[k] for k in range(len(texts))] == least_ids(list(range(len(texts))), pairs)


def test_families_of_short_sets_are_cut_by_their_number_too(spark, monkeypatch):
    """A block of a family is bounded in sets, so that many short ones do not meet in one task."""
    monkeypatch.setattr(minhash, "FAMILY_SETS", 10)
    texts = [" ".join(random.Random(k).sample("abcdefgh", 6)) for k in range(40)] + ["a b c d e f", "a b c d e f g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    rows = {x["id"]: x["component_id"] for x in minhash.near_duplicates(docs).collect()}
    assert [rows[k] for k in range(len(texts))] == least_ids(list(range(len(texts))), pairs)
    members = [(f"d{k}".encode(), 4, "key") for k in range(45)]
    shared = spark.createDataFrame([(key, d, n) for d, n, key in members], "key string, digest binary, n bigint")
    full = spark.createDataFrame([(d, np.arange(4, dtype=np.uint64).tobytes()) for d, *_ in members], "digest binary, members binary")
    nothing = spark.createDataFrame([], "id binary, component binary")
    joined = minhash._family_verifier
    counts = spark.sparkContext.accumulator(0)

    def counting(*args):
        run = joined(*args)

        def wrapped(table):
            counts.add(1)
            return run(table)
        return wrapped

    monkeypatch.setattr(minhash, "_family_verifier", counting)
    links = minhash._links_across(shared, nothing, full, 85, 100).collect()
    assert counts.value > 1 and len({x for link in links for x in (link["a"], link["b"])}) == 45


def test_memory_of_a_family_does_not_grow_with_the_square_of_its_sets():
    sets = [np.unique(np.random.default_rng(k).integers(0, 3000, 5).astype(np.uint64)) for k in range(4000)]
    sets[7] = sets[3999] = np.arange(5000, 5006, dtype=np.uint64)
    digests = [b"%05d" % k for k in range(len(sets))]
    table = pa.table({"digest": digests, "component": digests, "members": [x.tobytes() for x in sets]})
    tracemalloc.start()
    links = minhash._family_verifier(85, 100)(table).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    same, want = UnionFind(), UnionFind()
    for x in links:
        assert same.union(x["a"], x["b"])
    held = [set(x.tolist()) for x in sets]
    by_hash = {}
    for k, x in enumerate(held):
        for h in x:
            by_hash.setdefault(h, []).append(k)
    for k, x in enumerate(held):
        for other in {o for h in x for o in by_hash[h] if o > k}:
            if 100 * len(x & held[other]) >= 85 * len(x | held[other]):
                want.union(digests[k], digests[other])
    assert [same.find(d) for d in digests] == [want.find(d) for d in digests] and (b"00007", b"03999") in {(x["a"], x["b"]) for x in links}
    assert peak < 60e6


@pytest.mark.parametrize("per_task", [1_000_000, 3])
def test_components_of_chains_stars_and_noise(spark, monkeypatch, per_task):
    monkeypatch.setattr("corpusgraph.llm.components.STARS_PER_TASK", per_task)
    r = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (None, 5)]
    links += [(r.randrange(300, 340), r.randrange(300, 340)) for _ in range(30)]
    r.shuffle(links)
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    sets = UnionFind()
    for a, b in links:
        if a is not None and a != b:
            sets.union(a, b)
    assert got == {x: sets.find(x) for x in sets.parent if sets.find(x) != x}


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(5)
    vectors = []
    for _ in range(12):
        base = r.standard_normal(64)
        for _ in range(25):
            vectors.append((base + r.standard_normal(64) * r.choice([0.05, 0.15, 0.22])).tolist())
    vectors += [r.standard_normal(64).tolist() for _ in range(200)]
    vectors += [vectors[0]] * 6 + [[0.0] * 64, None, [], [float("nan")] * 64, [1.0, None] + [0.0] * 62, [float("inf")] * 64, [1.0, 2.0], [2.0, 4.0]]
    rows = [(k, v, "x") for k, v in enumerate(vectors)]
    got = {x["id"]: x for x in caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, copies string")).collect()}
    usable = [k for k, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for a, b in combinations(usable, 2):
        x, y = np.array(vectors[a]), np.array(vectors[b])
        if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
            pairs.append((a, b))
    counts = np.bincount(np.array(pairs).ravel(), minlength=len(vectors))
    assert len(got) == len(vectors)
    found = sum(got[k]["n_links"] for k in range(len(vectors)))
    assert found <= counts.sum() and found >= 0.99 * counts.sum()
    assert all(got[k]["n_links"] <= counts[k] for k in range(len(vectors)))
    want = least_ids(list(range(len(vectors))), pairs)
    assert sum(got[k]["component_id"] == want[k] for k in range(len(vectors))) >= 0.99 * len(vectors)


def test_hot_vectors_are_compared_in_blocks_and_counted_once(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 16)
    r = np.random.default_rng(7)
    base = r.standard_normal(32)
    rows = [(k, (base + r.standard_normal(32) * 0.02).tolist()) for k in range(70)]
    got = caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(x["n_links"], x["component_id"]) for x in got} == {(69, 0)}
    assert caps.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def plain_removal(rows, least):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    first, out = {}, {}
    for i, text in sorted(rows):
        spans = substrings.sentences(text or "")
        words = [word.findall(text[a:b]) for a, b in spans]
        runs = set()
        for begin in range(len(spans)):
            for stop in range(begin + 1, len(spans) + 1):
                if sum(map(len, words[begin:stop])) >= least:
                    runs.add((begin, stop))
                    break
        for stop in range(1, len(spans) + 1):
            for begin in range(stop - 1, -1, -1):
                if sum(map(len, words[begin:stop])) >= least:
                    runs.add((begin, stop))
                    break
        gone = set()
        for begin, stop in sorted(runs):
            key = tuple(w for s in words[begin:stop] for w in s)
            if first.setdefault(key, (i, begin)) != (i, begin):
                gone |= set(range(begin, stop))
        out[i] = (len(spans), len(gone))
    return out


def test_repeated_passages_go_from_all_but_the_first_document(spark):
    r = random.Random(2)

    def sentence(n):
        return " ".join(f"w{r.randrange(3000)}" for _ in range(n)) + r.choice([".", "!", "?"])

    passage = " ".join(sentence(9) for _ in range(7))
    long_one = sentence(60)
    rows = []
    for k in range(40):
        parts = [sentence(r.randrange(1, 15)) for _ in range(r.randrange(0, 9))]
        if k % 3 == 0:
            parts.insert(r.randrange(len(parts) + 1), passage)
        if k % 5 == 1:
            parts.insert(r.randrange(len(parts) + 1), "\n" + long_one + "\n")
        rows.append((k, " ".join(parts)))
    rows += [(40, ""), (41, "The. A. Of."), (42, "The. A. Of."), (43, passage + "\n" + passage)]
    docs = spark.createDataFrame([(i, t, "c", 5) for i, t in rows] + [(44, None, "c", 5)], "doc_id long, text string, spans string, h int")
    got = {x["id"]: x for x in substrings.remove_repeats(docs).collect()}
    want = plain_removal(rows, substrings.LEAST_WORDS)
    assert {i: (got[i]["n_sentences"], got[i]["n_removed"]) for i, _ in rows} == want
    assert passage in got[0]["text"] and all(passage not in got[k]["text"] for k in range(1, 44))
    assert sum(long_one in x["text"] for x in got.values()) == 1
    for i, text in rows:
        if not want[i][1]:
            assert got[i]["text"] == text
    assert got[44]["text"] == ""
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_null_and_repeated_ids_in_passages(spark):
    text = " ".join(f"w{k}" for k in range(80)) + "."
    rows = [(None, text), (None, text), (3, text), (3, text), (5, text)]
    got = sorted(((x["id"] is None, x["id"] or 0, x["n_removed"]) for x in substrings.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(False, 3, 0), (False, 3, 0), (False, 5, 1), (True, 0, 1), (True, 0, 1)]


def test_word_hashes_tell_words_apart():
    import pyarrow as pa
    texts = [None, "", "a", "A b\tc", "É é", "x" * 5000, "a b c d e f"]
    seen = {}
    for at, to, raw, ends in wordhash.chunks(pa.array(texts)):
        value, firsts = wordhash.words(raw, ends)
        for k in range(at, to):
            words = re.findall(r"[^\x20\x09-\x0D]+", (texts[k] or "").replace("A", "a"))
            own = value[firsts[k - at]:firsts[k - at + 1]]
            assert len(own) == len(words)
            for w, h in zip(words, own):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_everything_ignores_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 2)], "doc_id long, text string, id long").withColumn("tkey", F.lit("x"))
    assert minhash.near_duplicates(docs).count() == 1


def test_lists_grow_with_the_table_so_recall_stays():
    r = np.random.default_rng(11)
    x = r.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((400, 64))
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951 ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for classes in (10**4, 10**6, 10**8):
        words = int(np.ceil((classes * 2.0) ** 0.25))
        met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(caps.decode(x, words), caps.decode(y, words))]
        assert np.mean(met) > 0.99


def test_passages_of_scripts_without_spaces(spark):
    r = random.Random(8)
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(n))
    thai = lambda n: "".join(chr(r.randrange(0x0E01, 0x0E2E)) for _ in range(n))
    shared = "".join(han(12) + "。" for _ in range(20))
    phrases = " ".join(thai(15) for _ in range(12))
    rows = [(k, "".join(han(10) + "。" for _ in range(5)) + shared + "".join(han(9) + "！" for _ in range(4))) for k in range(6)]
    rows += [(10 + k, thai(40) + " " + phrases + " " + thai(30)) for k in range(4)]
    rows += [(20, han(40)), (21, "kurz " * 40), (22, "日本語 mixed 日本 words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["id"]: x["text"] for x in substrings.remove_repeats(docs).collect()}
    assert shared in got[0] and all(shared not in got[k] and len(got[k]) == len(rows[k][1]) - len(shared) for k in range(1, 6))
    assert phrases in got[10] and all(phrases not in got[k] for k in range(11, 14))
    assert all(got[k] == dict(rows)[k] for k in (20, 21, 22))


def test_letters_of_unspaced_scripts_are_words():
    raw, ends = wordhash.text_bytes(pa.array(["ab 日本x語 c", "", "ไทย ok", "𠀀𠀁", "é日"]))
    value, firsts = substrings._units(raw, ends)
    assert np.diff(firsts).tolist() == [6, 0, 4, 2, 2]
    assert value[0] == wordhash.words(*wordhash.text_bytes(pa.array(["ab"])), fold=False)[0][0]
