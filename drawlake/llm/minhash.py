"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, components.

Method. A document's set holds the hashes of its distinct word shingles. SuperMinHash gives each
element one slot per level of a random permutation of the slots, and the value level + uniform; a
slot keeps its smallest value. Levels run over all elements at once, and a document stops as soon as
all its slots are filled, since later levels can only give larger values. Bands of slot values find
candidates; links are confirmed on the full sets.

Scale. Identical sets are one class. In each band bucket all members are compared with the smallest
one only. Members of buckets that then still hold several components are searched once more, each class once
however many buckets it is in. Their elements are ordered from rare to frequent; two sets that are similar
enough must share one of their first elements, so sets fall into clusters that are joined by such elements.
A cluster with several components is compared in blocks of bounded size, which count all common
elements by inverted lists and give one link for each pair of components they join. So copies never
become all pairs, a full set travels once unless its cluster outgrows a block, and no link between different
components is lost but by banding: with 4 rows and 20 bands a pair at 0.85 is missed with probability below
4e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.llm.bytesops import BYTE_VALUES, LOWER, U64, blocks, mix, prefix_hash, range_hash, word_bounds
from drawlake.llm.common import connected_components, heavy_keys, materialize, skewed_join

BLOCK = 1_000_000  # elements


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block; a shorter text is one shingle, one without words none."""
    begin, end = word_bounds(data)
    of_word = mix(range_hash(prefix_hash(BYTE_VALUES[LOWER[data]]), begin, end))
    bounds = np.searchsorted(begin, starts)
    n = len(of_word)
    rolled = np.zeros(n, U64)
    for k in range(words):
        part = of_word[k:] * U64((0xD1B54A32D192ED03 * (2 * k + 1)) % (1 << 64) | 1)
        rolled[: n - k] += part[: max(n - k, 0)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = hashlib.blake2b(of_word[a:b].tobytes() + bytes([b - a]), digest_size=8).digest()
            out.append(np.frombuffer(whole, U64))
        else:
            out.append(np.zeros(0, U64))
    return out


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash signatures, one row for each set; rows of empty sets stay infinite."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.full(len(sets) * slots, np.inf)
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
    owner = np.repeat(np.arange(len(sets)), sizes)

    def draw(x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        s = mix(x + U64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64)))
        r = (s >> U64(11)).astype(np.float64) * 2.0**-53
        k = level + ((mix(s) >> U64(33)) * U64(slots - level) >> U64(31)).astype(np.int64)
        return r, k

    r, k = draw(elements, 0)
    np.minimum.at(values, owner * slots + k, r)
    filled = lambda: np.isfinite(values.reshape(-1, slots)).all(1)
    active = ~filled()[owner]
    elements, owner, k = elements[active], owner[active], k[active]
    order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
    rows = np.arange(len(elements))
    order[rows, k], order[rows, 0] = order[rows, 0], order[rows, k]
    for level in range(1, slots):
        if not len(elements):
            break
        r, k = draw(elements, level)
        rows = np.arange(len(elements))
        slot = order[rows, k]
        order[rows, k] = order[rows, level]
        order[rows, level] = slot
        np.minimum.at(values, owner * slots + slot, r + level)
        active = ~filled()[owner]
        elements, owner, order = elements[active], owner[active], order[active]
    return values.reshape(-1, slots)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` slots."""
    bits = signature.view(U64).reshape(len(signature), -1, rows)
    key = np.broadcast_to(np.arange(bits.shape[1], dtype=U64), bits.shape[:2])
    for i in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return key


def _signatures(words: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, keys = [], [], []
            for _, _, data, starts in blocks(batch.column(2)):
                sets = shingle_sets(data, starts, words)
                n += [len(s) for s in sets]
                digest += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                keys.append(band_keys(super_minhash(sets, rows * bands), rows).view(np.int64))
            flat = np.concatenate(keys).reshape(-1) if keys else np.zeros(0, np.int64)
            bands_column = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), bands_column], ["doc_id", "text_hash", "n_shingles", "set_hash", "bands"])

    return run


def _elements(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, starts in blocks(batch.column(1)):
                out += [s.view(np.int64) for s in shingle_sets(data, starts, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(out)], ["id", "elements"])

    return run


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(s) for s in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), pa.int64()))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs(u, v)`` whose full sets are similar enough."""
    side = lambda name: sets.select(F.col("id").alias(name), F.col("elements").alias(f"s{name}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").withColumn("both", F.size(F.array_intersect("su", "sv")))
    return both.where(f"100 * both >= {percent} * (size(su) + size(sv) - both)").select("u", "v")


def _first_elements(asked: DataFrame, percent: int) -> DataFrame:
    """``(id, element)``: the elements of ``asked(doc, id, elements)`` of which similar sets must share one.

    A set's elements stand in order of how many sets hold them, then of value, and the first
    n - ceil(n * percent / 100) + 1 count. Elements of one set only come first and are left out.
    """
    held = asked.select("doc", F.size("elements").alias("n"), F.explode("elements").alias("element"))
    common = held.groupBy("element").agg(F.count("*").alias("sets")).where("sets > 1")
    shared = held.join(common, "element").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "element"))).alias("own"))
    first = F.size("own") - F.ceil(F.col("n") * percent / 100) + 1
    rows = shared.withColumn("own", F.slice("own", F.lit(1), F.greatest(first, F.lit(0)).cast("int")))
    return rows.select("doc", F.explode("own.element").alias("element")).join(asked.select("doc", "id"), "doc").select("id", "element")


def _overlaps(percent: int):
    """Links that join different components within each block of a batch."""

    def block(rows: pd.DataFrame) -> list[tuple]:
        rows = rows.drop_duplicates("id")
        ids, side = rows["id"].to_numpy(), rows["side"].to_numpy()
        names, comp = np.unique(rows["component"].to_numpy(), return_inverse=True)
        if len(names) < 2:
            return []
        n = np.array([len(x) for x in rows["elements"]])
        bounds = np.r_[0, np.cumsum(n)]
        _, code = np.unique(np.concatenate(rows["elements"].to_list()), return_inverse=True)
        order = np.argsort(code, kind="stable")
        holder = np.repeat(np.arange(len(n)), n)[order]  # of each element in turn
        starts = np.r_[0, np.cumsum(np.bincount(code))]
        links = []
        for i in np.flatnonzero(side == side.min()):
            own = code[bounds[i] : bounds[i + 1]]
            size = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            both = np.bincount(holder[at], minlength=len(n))
            for j in np.flatnonzero((100 * both >= percent * (n[i] + n - both)) & (comp != comp[i])):
                if comp[j] != comp[i]:
                    links.append((ids[i], ids[j]))
                    comp[comp == comp[j]] = comp[i]
        return links

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        found = [link for _, rows in batch.groupby(["cluster", "lo", "hi"]) for link in block(rows)]
        return pd.DataFrame(found, columns=["u", "v"], dtype="object")

    return run


def _missing_links(members: DataFrame, heavy: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components among the members of buckets that hold several."""
    named = members.where("size > 2").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    unsettled = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    asked = skewed_join(named, materialize(unsettled, "unsettled"), "key", heavy, "left_semi").select("id", "component").distinct()
    asked = materialize(asked.join(sets, "id").select(F.monotonically_increasing_id().alias("doc"), "id", "component", "elements"), "asked")
    first = _first_elements(asked.drop("component"), percent).join(asked.select("id", "component"), "id")
    first = materialize(first, "first")
    pivots = first.groupBy("element").agg(F.min("id").alias("pivot"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("element", "pivot")
    edges = first.join(pivots, "element").where("id <> pivot").select(F.col("pivot").alias("u"), F.col("id").alias("v"))
    clusters = connected_components(edges).withColumnRenamed("component", "cluster")

    rows = clusters.join(asked, "id")
    parts = rows.groupBy("cluster").agg(F.ceil(F.sum(F.size("elements")) / BLOCK).cast("int").alias("parts"))
    rows = rows.join(parts, "cluster").withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("cluster", "id", "component", "elements", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    bins = max(64, asked.count() // 1000)  # several small clusters share a task
    batch = F.when(F.col("hi") == 0, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.xxhash64("cluster", "lo", "hi"))
    return rows.groupBy(batch.alias("batch")).applyInPandas(_overlaps(percent), "u binary, v binary")


def _components(docs: DataFrame, words: int, percent: int, rows: int, bands: int) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, component_id)`` for each row of ``docs(doc_id, text)``."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = materialize(docs.mapInArrow(_signatures(words, rows, bands), "doc_id long, text_hash long, n_shingles long, set_hash binary, bands array<long>"), "signed")
    real, alone = signed.where("n_shingles > 0 and doc_id is not null"), signed.where("n_shingles = 0 or doc_id is null")
    classes = real.groupBy(F.col("set_hash").alias("id")).agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")

    spread = classes.select("id", "n_shingles", F.explode("bands").alias("key"))  # keys of different bands differ
    buckets = spread.groupBy("key").agg(F.min(F.struct("id", "n_shingles")).alias("pivot"), F.count("*").alias("size")).where("size > 1")
    buckets = materialize(buckets, "keys")
    heavy = heavy_keys(buckets, "key", "size")
    members = materialize(skewed_join(spread, buckets, "key", heavy).select("key", "size", "id", "n_shingles", "pivot"), "buckets")
    pairs = members.where("id <> pivot.id").where(f"100 * least(n_shingles, pivot.n_shingles) >= {percent} * greatest(n_shingles, pivot.n_shingles)")
    pairs = pairs.select(F.col("pivot.id").alias("u"), F.col("id").alias("v")).distinct()

    wanted = classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "rep.doc_id", "rep.text_hash")
    texts = docs.join(wanted, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    sets = materialize(texts.select("id", "text").mapInArrow(_elements(words), "id binary, elements array<long>"), "sets")
    links = materialize(_confirmed(pairs, sets, percent), "links")
    found = connected_components(links)
    more = materialize(_missing_links(members, heavy, found, sets, percent), "more")
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))

    linked = found.join(classes.select("id", F.col("rep.doc_id").alias("doc_id")), "id")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = classes.select("id", "rep.doc_id").join(linked.join(least, "component").select("id", "least"), "id", "left").select(F.col("id").alias("set_hash"), F.coalesce("least", "doc_id").alias("component_id"))
    out = ["doc_id", "text_hash", "n_shingles", "component_id"]
    return real.join(named, "set_hash").select(out).unionByName(alone.withColumn("component_id", F.col("doc_id")).select(out))


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, rows: int = 4, bands: int = 20) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id, kept)``, one row for each row.

    Links join documents with 100 * |A and B| >= percent * |A or B|. ``component_id`` is the smallest
    doc_id reachable, ``kept`` marks it. Null, empty and blank texts have no shingles and link with nothing;
    a null doc_id stays alone (component_id null, kept true). Repeated rows are one class and are all
    kept if their id is. Rows of one doc_id with different texts are judged each by its own text, and links
    do not run through a common id. Very long texts are used whole; no rows give no rows. Other columns are
    ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _components(docs, words, percent, rows, bands)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 3, bands: int = 24) -> DataFrame:
    """``docs`` without the rows whose doc_id is not the smallest of their component; columns are unchanged.

    A row is dropped by its own text: another text under the same doc_id stays. Repeated rows stay or go
    together; null ids stay.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = _components(own, words, percent, rows, bands).where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = (docs["doc_id"].cast("long") == F.col("_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_hash"))
    return docs.join(gone, same, "left_anti")
