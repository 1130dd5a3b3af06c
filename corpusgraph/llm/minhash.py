"""Near-duplicate documents by SuperMinHash signatures."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import wordhash
from corpusgraph.llm.components import UnionFind, components
from corpusgraph.llm.tasks import lean
from corpusgraph.plans.loops import cut

SLOTS = 64
BANDS = 16
#: Standard errors below the threshold at which an estimate still sends a pair to the exact check.
SLACK = 4.5
#: Bytes of text whose sets are made and signed at once.
CHUNK_BYTES = 1 << 19
#: Hashes and sets in one block of a family, and rows and hashes in one slice of its matrix product.
FAMILY_SHINGLES = 400_000
FAMILY_SETS = 2_000
FAMILY_ROWS, FAMILY_COLUMNS = 512, 1024
_LEVEL = np.uint64(56)
_NONE = np.uint64(2**64 - 1)


def superminhash(value: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signature of each set of hashes, one row of ``slots`` values per set.

    Each element walks through a random permutation of the slots, drawn step by step
    from its own hash; at step j it offers ``j + r``, r in [0, 1), to one slot. A slot
    keeps the least offer, so a set stops after the first step that leaves every slot
    with an offer of that step or an earlier one. Large sets stop after step 0.
    The steps of all elements of the batch are taken together.
    """
    texts = len(offsets) - 1
    best = np.full(texts * slots, _NONE, np.uint64)
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    state = value
    order = None
    full = np.diff(offsets) == 0
    for step in range(slots):
        draw = wordhash.mixed(state + np.uint64((step + 1) * 0xA0761D6478BD642F % 2**64))
        pick = step + (((draw >> np.uint64(32)) * np.uint64(slots - step)) >> np.uint64(32)).astype(np.int64)
        offer = (np.uint64(step) << _LEVEL) | (wordhash.mixed(draw ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(8))
        if order is None:
            slot = pick
        else:
            rows = np.arange(len(state))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[rows, step]
            order[rows, step] = slot
        np.minimum.at(best, owner * slots + slot, offer)
        full |= (best.reshape(texts, slots) < (np.uint64(step + 1) << _LEVEL)).all(axis=1)
        if full.all():
            break
        stay = ~full[owner]
        if order is None:
            state, owner = state[stay], owner[stay]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(state), 1))
            rows, first = np.arange(len(state)), pick[stay]
            order[rows, first] = 0
            order[rows, 0] = first
        elif not stay.all():
            state, owner, order = state[stay], owner[stay], order[stay]
    return best.reshape(texts, slots)


def _digests(value: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128 bits per set of hashes, whatever their order."""
    sums = []
    for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(wordhash.mixed(value + np.uint64(salt)), out=total[1:])
        sums.append(wordhash.mixed(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)))
    return [x.tobytes() for x in np.stack(sums, axis=1)]


def _shingle_sets(raw, ends, words):
    return wordhash.distinct_per_text(*wordhash.runs(*wordhash.words(raw, ends), words))


def _signer(words: int, slots: int, bands: int):
    @lean
    def sign(batches):
        for batch in batches:
            for at, to, raw, ends in wordhash.chunks(batch.column("text"), CHUNK_BYTES):
                value, offsets = _shingle_sets(raw, ends, words)
                best = superminhash(value, offsets, slots)
                rows = best.reshape(to - at, bands, slots // bands)
                key = np.zeros((to - at, bands), np.uint64)
                for k in range(slots // bands):
                    key = wordhash.mixed(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, k])
                key = wordhash.mixed(key + np.arange(bands, dtype=np.uint64))
                sketch = wordhash.mixed(best).astype(np.uint8)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("tkey"), pa.array(_digests(value, offsets), pa.binary()),
                    pa.array(np.diff(offsets), pa.int64()), pa.array([x.tobytes() for x in sketch], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (to - at) * bands + 1, bands), pa.int32()),
                                             pa.array(key.view(np.int64).ravel()))],
                    ["id", "tkey", "digest", "n", "sketch", "bands"])
    return sign


def _set_maker(words: int):
    @lean
    def make(batches):
        for batch in batches:
            for at, to, raw, ends in wordhash.chunks(batch.column("text"), CHUNK_BYTES):
                value, offsets = _shingle_sets(raw, ends, words)
                yield pa.RecordBatch.from_arrays([
                    batch.column("digest").slice(at, to - at),
                    pa.array([value[i:j].tobytes() for i, j in zip(offsets, offsets[1:])], pa.binary())], ["digest", "members"])
    return make


def _estimator(floor: float, slots: int):
    """Keeps pairs whose sketches agree in at least ``floor`` of their slots."""
    @lean
    def keep(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, slots) for c in ("sa", "sb"))
            rows = np.flatnonzero((x == y).sum(axis=1) >= floor * slots)
            yield batch.take(pa.array(rows)).select(["a", "b"])
    return keep


def _verifier(numerator: int, denominator: int):
    """Keeps pairs with ``denominator * intersection >= numerator * union`` of the full sets."""
    @lean
    def keep(batches):
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column("ma"), batch.column("mb"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if denominator * shared >= numerator * (len(both) - shared):
                    good.append(i)
            yield batch.take(pa.array(good, pa.int64())).select(["a", "b"])
    return keep


def _family_verifier(numerator: int, denominator: int):
    """Links that join the components of one family of sets, at most one per member.

    Intersections of all pairs come from products of 0/1 matrices over slices of the
    sets and of the hashes that at least two members hold, so memory does not grow with their square.
    """
    def join(table):
        digests, parts = table.column("digest").to_pylist(), table.column("component").to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members").combine_chunks()]
        sizes = np.array([len(x) for x in sets], np.int64)
        codes, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
        owner = np.repeat(np.arange(len(sets)), sizes)
        common = times[codes] > 1
        number = np.cumsum(times > 1) - 1
        codes, owner = number[codes[common]], owner[common]
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        slices = [(low, *np.searchsorted(codes, [low, low + FAMILY_COLUMNS])) for low in range(0, int(codes[-1]) + 1 if len(codes) else 0, FAMILY_COLUMNS)]
        groups, found = UnionFind(), []
        for first in range(0, len(sets), FAMILY_ROWS):
            rows = np.arange(first, min(first + FAMILY_ROWS, len(sets)))
            shared = np.zeros((len(rows), len(sets) - first), np.float32)
            for low, i, j in slices:
                held = np.zeros((len(sets) - first, FAMILY_COLUMNS), np.float32)
                here = owner[i:j] >= first
                held[owner[i:j][here] - first, codes[i:j][here] - low] = 1
                shared += held[:len(rows)] @ held.T
            for x in rows.tolist():
                both = shared[x - first, x + 1 - first:].astype(np.int64)
                for y in (x + 1 + np.flatnonzero(denominator * both >= numerator * (sizes[x] + sizes[x + 1:] - both))).tolist():
                    if groups.union(parts[x], parts[y]):
                        found.append((digests[x], digests[y]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})
    return join


def _sets(rows: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """``(digest, members)``: the full set of each class in ``needed (digest, rep)``, made from one text of it."""
    needed = needed.select("digest", F.col("rep.id").alias("rep_id"), F.col("rep.tkey").alias("tkey"))
    texts = rows.join(needed, (rows["tkey"] == needed["tkey"]) & rows["id"].eqNullSafe(needed["rep_id"])).groupBy(
        "digest").agg(F.max("text").alias("text"))
    return cut(texts.mapInArrow(_set_maker(words), "digest binary, members binary"))


def _links_across(shared: DataFrame, groups: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links between different components that meet in a bucket.

    Classes that such buckets connect form a family. A family is cut into blocks of
    about ``FAMILY_SHINGLES`` hashes and ``FAMILY_SETS`` sets at most, and each pair of blocks is one group, so no group
    grows with the family.
    """
    members = shared.select("key", "digest", "n").join(groups.withColumnRenamed("id", "digest"), "digest", "left").withColumn(
        "component", F.coalesce("component", "digest"))
    apart = members.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("digest").alias("first")).filter("low <> high")
    members = cut(members.join(apart.select("key", "first"), "key"))
    families = components(members.select(F.col("digest").alias("a"), F.col("first").alias("b"))).withColumnsRenamed(
        {"id": "digest", "component": "family"})
    each = cut(members.groupBy("digest").agg(F.any_value("n").alias("n"), F.any_value("component").alias("component")).join(
        families, "digest", "left").withColumn("family", F.coalesce("family", "digest")))
    blocks = each.groupBy("family").agg(F.ceil(F.greatest(
        F.sum("n") / FAMILY_SHINGLES, F.count("*") / FAMILY_SETS)).cast("int").alias("blocks"))
    placed = each.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "digest", "component", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return cut(placed.join(sets, "digest").groupBy("family", "i", "j").applyInArrow(
        _family_verifier(numerator, denominator), "a binary, b binary"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5,
                    threshold: tuple[int, int] = (85, 100), slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """Group documents whose word shingles overlap by at least ``threshold``.

    Returns one row per row of ``docs``: ``id, tkey, n_shingles, class_id, component_key,
    component_id, kept``; ``tkey`` is the MD5 of the text. Links: ``100 * intersection >= 85 * union`` of the full sets.

    1. SuperMinHash signature, band keys and a digest of the set, in one pass over the texts.
    2. Equal sets become one class, so copies cost nothing afterwards.
    3. Every class is compared with one leader per band bucket; each band draws its own
       leaders, so a family meets up to ``bands`` of them, and a bucket of n classes gives
       n - 1 pairs, not n squared.
    4. Where buckets still hold several components, the sets that they connect are compared
       in blocks, and only links that join components leave a task. So no pair that shares
       a bucket is lost. At a similarity of 0.85 two documents share
       none of 16 buckets of four slots with a chance of 7 in a million.
    5. Full sets confirm; union-find on the confirmed links.

    Nulls: a null text is an empty text; its set is empty and links with nothing. A null id
    takes part; it is no component's id unless all ids there are null. Repeated rows have
    equal sets and are linked. Other columns are ignored. An empty table gives an empty result.
    """
    numerator, denominator = threshold
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("tkey"))
    id_type = rows.schema["id"].dataType.simpleString()
    signed = cut(rows.mapInArrow(
        _signer(words, slots, bands), f"id {id_type}, tkey binary, digest binary, n bigint, sketch binary, bands array<bigint>"))
    classes = cut(signed.filter("n > 0").groupBy("digest").agg(
        F.min(F.struct("id", "tkey")).alias("rep"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"),
        F.any_value("bands").alias("bands")))
    spread = classes.select("digest", "n", F.explode("bands").alias("key"))
    leaders = spread.groupBy("key").agg(
        F.min(F.struct(F.xxhash64("digest", "key"), "digest", "n")).alias("lead"), F.count("*").alias("size")).filter("size > 1")
    shared = cut(spread.join(leaders, "key"))
    sets = _sets(rows, shared.select("digest").distinct().join(classes, "digest"), words)
    fit = denominator * F.least("n", "lead.n") >= numerator * F.greatest("n", "lead.n")
    pairs = shared.filter(F.col("digest") != F.col("lead.digest")).filter(fit).select(
        F.least("digest", "lead.digest").alias("a"), F.greatest("digest", "lead.digest").alias("b")).distinct()
    share = numerator / denominator
    sketches = classes.select("digest", "sketch")
    likely = cut(pairs.join(sketches.withColumnsRenamed({"digest": "a", "sketch": "sa"}), "a").join(
        sketches.withColumnsRenamed({"digest": "b", "sketch": "sb"}), "b").mapInArrow(
        _estimator(share - SLACK * (share * (1 - share) / slots) ** 0.5, slots), "a binary, b binary"))
    links = cut(likely.join(sets.withColumnsRenamed({"digest": "a", "members": "ma"}), "a").join(
        sets.withColumnsRenamed({"digest": "b", "members": "mb"}), "b").mapInArrow(
        _verifier(numerator, denominator), "a binary, b binary"))
    groups = components(links)
    links = links.unionByName(_links_across(shared, groups, sets, numerator, denominator))
    groups = components(links)
    keyed = signed.select("id", "tkey", F.col("n").alias("n_shingles"), "digest").join(
        groups.withColumnRenamed("id", "digest"), "digest", "left").withColumn(
        "component_key", F.when(F.col("n_shingles") > 0, F.coalesce("component", "digest")))
    least = keyed.filter("component_key IS NOT NULL").groupBy("component_key").agg(F.min("id").alias("least"))
    return keyed.join(least, "component_key", "left").select(
        "id", "tkey", "n_shingles", F.col("digest").alias("class_id"), "component_key",
        F.when(F.col("component_key").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id")).withColumn(
        "kept", F.col("id").eqNullSafe(F.col("component_id")))
