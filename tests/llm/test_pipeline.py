"""The pipeline and the registered queries at the smallest scale."""

import hashlib
import random
import re
from itertools import combinations

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import tiktoken

import __spark_entry__ as entry
from corpusgraph.llm import bpe, catalog
from corpusgraph.llm.components import UnionFind

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in catalog.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(catalog.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(catalog.ORACLES) <= set(entry.oracle_sql())


def test_queries_with_sql_twins_agree(spark):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    for name, sql in catalog.ORACLES.items():
        frame = catalog.QUERIES[name](spark, FOLDER)
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        want = sorted(tuple(r[names.index(c)] for c in frame.columns) for r in cursor.fetchall())
        assert sorted(tuple(r) for r in frame.collect()) == want, name


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    toxic, distinct, masked, mixed, coded = kept
    assert {r["doc_id"] for r in distinct} <= {r["doc_id"] for r in toxic}
    assert len({r["text"] for r in distinct}) == len([r for r in distinct if r["text"]]) or any(not r["text"] for r in distinct)
    assert {r["doc_id"] for r in masked} == {r["doc_id"] for r in distinct}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in masked}
    times = {}
    for r in mixed:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3 and len(coded) == len(mixed)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=dict(
        bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))))
    texts = {r["doc_id"]: r["text"] for r in mixed}
    for r in coded[:60]:
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]] or ""), "<u4")
        assert hashlib.sha256(r["ids"]).digest() == hashlib.sha256(ids.tobytes()).digest()


def test_stages_take_nulls_repeats_and_empty_tables(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long, _tkey string, id int"
    rows = [(1, "some words that are here twice", "en", "a", 30, "x", 1), (1, "some words that are here twice", "en", "a", 30, "x", 1),
            (None, None, None, None, None, None, None), (3, "", "en", None, 0, "x", 1), (4, "mail a@b.example.com now", "en", "b", 24, "x", 1)]
    for number, part in enumerate((rows, [])):
        docs = spark.createDataFrame(part, shape)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            place = str(tmp_path / f"{number}-{k}")
            stage(spark, docs, FOLDER).write.parquet(place)
            docs = spark.read.parquet(place)
        assert docs.count() == 0 if not part else docs.filter("doc_id = 1").count() <= 3


def _near_groups(texts):
    """Texts' groups by brute force at 0.8, and the similarities."""
    sets, groups, levels = [], UnionFind(), []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b]:
            levels.append(len(sets[a] & sets[b]) / len(sets[a] | sets[b]))
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups.union(a, b)
    return [groups.find(k) for k in range(len(texts))], levels


def test_near_copies_stage_equals_brute_force_at_four_fifths(spark):
    r = random.Random(12)
    texts = [None, "", " \n", "one two", "One two", "a b c d e"]
    for words, edits in [(500, 10), (500, 11), (300, 6), (120, 2), (120, 3), (60, 1), (40, 1), (500, 14)] * 8:
        base = [f"w{r.randrange(3000)}" for _ in range(words)]
        edited = list(base)
        for k in r.sample(range(5, words - 5), edits):
            edited[k] = f"x{r.randrange(10**6)}"
        texts += [" ".join(base), " ".join(edited)]
    groups, levels = _near_groups(texts)
    assert sum(0.8 <= x < 0.85 for x in levels) > 20 and sum(0.7 < x < 0.8 for x in levels) > 5
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    least = {}
    for k, g in enumerate(groups):
        least.setdefault(g, k)
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(least.values())
