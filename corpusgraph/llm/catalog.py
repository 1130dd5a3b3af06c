"""One query per operator over its whole table, and DuckDB SQL where SQL can say it."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import (
    bpe, caps, contamination, fingerprint, merkle, minhash, mixing, ordinal, personal, ranked, sitetree, substrings, tokenfile,
)
from corpusgraph.session import checkpoint_folder

QUERIES = {}
ORACLES = {}


def query(name: str):
    def add(function):
        QUERIES[name] = function
        return function
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mixing")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, mixing.word_count(F.col("text"))).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLES["op1_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null' || coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::VARCHAR)) AS h
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 3.0::DOUBLE * source_size AS cap FROM per),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k,
    (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS free
  FROM ranked),
stop AS (SELECT min(k) AS k FROM levels WHERE NOT remaining * w / free > cap),
level AS (SELECT remaining, free, levels.k FROM levels JOIN stop USING (k)),
targets AS (
  SELECT l.source, l.source_size, CASE WHEN level.k IS NULL OR l.k < level.k THEN l.cap ELSE level.remaining * l.w / level.free END::DOUBLE AS target
  FROM levels l LEFT JOIN level ON true),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.target / greatest(t.source_size, 1) AS rate,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2.0 AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + (middle <= (rate - floor(rate)) * source_size)::BIGINT))::BIGINT AS taken
FROM placed
"""


@query("op2_vector_dedup")
def op2(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return caps.near_vectors(vectors).withColumnRenamed("id", "vec_id")


ORACLES["op2_vector_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sound AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


@query("op3_minhash_dedup")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


ORACLES["op3_minhash_dedup"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM worded),
sized AS (SELECT doc_id, len(s)::BIGINT AS n FROM shingled),
each AS (SELECT doc_id, unnest(s) AS x FROM shingled),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least USING (doc_id)
"""


@query("op4_token_file")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{checkpoint_folder(spark).rstrip('/')}/corpusgraph/tokens-{uuid.uuid4().hex}"
    tokenfile.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end=0,
                           added=True)
    return tokenfile.read_tokens(spark, path, digest=True).withColumnRenamed("id", "doc_id")


@query("op7_byte_bpe")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True).select(
        F.col("id").alias("doc_id"), "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


@query("op10_fingerprint")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint.fingerprints(docs).withColumnRenamed("id", "doc_id")


@query("op9_substring_dedup")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).withColumnRenamed("id", "doc_id")


@query("op8_main_text")
def op8(spark, sf_dir):
    return sitetree.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumnRenamed("page", "page_id")


@query("op5_personal_data")
def op5(spark, sf_dir):
    return personal.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op6_toxicity")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return ordinal.grade(docs, ordinal.train(docs, labels)).withColumnRenamed("id", "doc_id")


#: Words of the operators 11 and 13 in DuckDB; ``{0}`` is the text.
_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op11_decontamination")
def op11(spark, sf_dir):
    found = contamination.find_windows(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                       table(spark, sf_dir, "benchmark").select("item_id", "text"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLES["op11_decontamination"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') AS x, least(len(w), 10) AS size FROM (
    SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
  SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS x FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
met AS MATERIALIZED (SELECT r.doc_id, r.p, r.size, item_id FROM runs r JOIN windows USING (x, size)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM met) GROUP BY doc_id),
held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (
    SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN held USING (doc_id)
"""


@query("op12_merkle_manifest")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    leaves = docs.withColumn("leaf", merkle.leaf("doc_id", "source", "lang", "n_chars", "text"))
    tampered = merkle.leaf("doc_id", "source", "lang", "n_chars", F.translate("text", upper, upper.lower()))
    found = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, tampered).otherwise(F.col("leaf"))
    return merkle.manifest(leaves.select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), "leaf", found.alias("found"))).withColumnRenamed(
        "id", "doc_id")


def _merkle_sql(levels: int = 8, upper: int = 3) -> str:
    """The tree level by level, as many as ``8 ** levels`` rows of a language and ``8 ** upper`` languages need."""
    def value(x):
        return f"coalesce(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')"

    def leaf(text):
        return "sha256(" + " || ".join([value("doc_id"), value("source"), value("lang"), value("n_chars"), value(text)]) + ")"

    def tree(name, count):
        steps = []
        for k in range(count):
            steps.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT g, p // 8 AS p, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h,
    (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) > 1 THEN list(h ORDER BY p) ELSE [] END AS run FROM {name}{k} GROUP BY g, p // 8)""")
        return ",\n".join(steps)

    def siblings(name, count):
        return " || ".join(f"array_to_string(list_concat({name}{k + 1}.run[:({name}.p // {8 ** k}) % 8], "
                           f"{name}{k + 1}.run[({name}.p // {8 ** k}) % 8 + 2:]), '')" for k in range(count))

    def folded(name, count, start):
        for k in range(count):
            r, at = f"{name}{k + 1}.run", f"(({name}.p // {8 ** k}) % 8)"
            start = (f"(CASE WHEN len({r}) = 0 THEN {start} ELSE sha256(array_to_string({r}[:{at}], '') || {start} || "
                     f"array_to_string({r}[{at} + 2:], '')) END)")
        return start

    def joins(name, count):
        return " ".join(f"JOIN {name}{k + 1} ON {name}{k + 1}.g = {name}.g AND {name}{k + 1}.p = {name}.p // {8 ** (k + 1)}"
                        for k in range(count))

    byte = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), " \
           "lambda a, c: xor(a >> 8, list_reduce(list_prepend(xor(a, c) & 255, range(8)), " \
           "lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)))"
    upper_case = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = f"translate(text, '{upper_case}', '{upper_case.lower()}')"
    return f"""
WITH langs AS (SELECT lang AS name, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)),
t AS MATERIALIZED (
  SELECT doc_id, g, {leaf("text")} AS h, CASE WHEN xor({byte}, 4294967295::BIGINT) % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS found,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS p, count(*) OVER (PARTITION BY g) AS n
  FROM documents d JOIN langs l ON d.lang IS NOT DISTINCT FROM l.name),
t0 AS (SELECT g, p, h, n FROM t),
{tree("t", levels)},
s AS MATERIALIZED (SELECT 0 AS g, g AS p, h, count(*) OVER () AS n FROM t{levels}),
s0 AS (SELECT g, p, h, n FROM s),
{tree("s", upper)},
up AS MATERIALIZED (
  SELECT t.doc_id, t.h AS leaf, t.g, {siblings("t", levels)} AS inner_proof, {folded("t", levels, "t.found")} AS folded FROM t {joins("t", levels)}),
top AS MATERIALIZED (SELECT s.p AS lang_no, s.h AS subroot, s{upper}.h AS root, s.g, s.p, {siblings("s", upper)} AS outer_proof FROM s {joins("s", upper)}),
both_ AS (
  SELECT up.doc_id, up.leaf, top.subroot, top.root, inner_proof || outer_proof AS proof, s.g, s.p, up.folded
  FROM up JOIN top ON top.lang_no = up.g JOIN s ON s.p = up.g)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM (
  SELECT s.*, {folded("s", upper, "s.folded")} AS folded_root FROM both_ s {joins("s", upper)})
"""


ORACLES["op12_merkle_manifest"] = _merkle_sql()


@query("op13_ranked_search")
def op13(spark, sf_dir):
    found = ranked.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


ORACLES["op13_ranked_search"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
size AS MATERIALIZED (SELECT doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM size),
tf AS MATERIALIZED (SELECT doc_id, x, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY doc_id, x),
terms AS (SELECT DISTINCT item_id, unnest({_WORDS.format("text")}) AS x FROM benchmark),
weight AS (
  SELECT x, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (
    SELECT x, count(*)::BIGINT AS df FROM tf WHERE x IN (SELECT x FROM terms) GROUP BY x), whole),
scored AS (
  SELECT item_id, doc_id, sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll))))::BIGINT AS score
  FROM terms JOIN tf USING (x) JOIN weight USING (x) JOIN size USING (doc_id), whole GROUP BY item_id, doc_id),
ranks AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 10
"""
