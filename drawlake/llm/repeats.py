"""Exact repeated substrings, removed where a string of ``length`` bytes also starts elsewhere.

1. Anchors. In every window of ``length`` bytes the smallest hash of a ``GRAM``-byte string (leftmost of
   equals) marks an anchor: about one byte in 170. Equal windows mark equal anchors at equal offsets, so
   every repeat shows as anchors with equal hashes. Whole texts that are equal are one class first: their
   bytes are all repeated, and one of them stands for the class. Long periodic runs are settled on the
   spot and keep only the anchors that other texts may need.
2. Occurrences. Only anchors whose hash occurs at least twice get their context (the bytes before and
   after that a window through the anchor can reach). Equal contexts of one text, as repeated lines have
   them, are one row with all their places.
3. Interval tree. The occurrences of one anchor hash, sorted by the bytes from the anchor on, are an
   enhanced suffix array. A stack scan over its common-prefix lengths visits every interval of the tree;
   the members of an interval share a prefix, and sorting them by the bytes before the anchor tests their
   left-extension diversity: neighbours that share enough to the left are occurrences of one maximal
   repeat. Every member gets its longest extension on both sides, so all occurrences are found, not just
   neighbours in the array.
4. The extents of all occurrences of a text are merged and cut out.

Scale. An anchor with more than ``HOT`` contexts, counted once for each text, is never gathered in one task:
its windows are hashed and counted by grouped aggregation, which combines on the map side. To find the
anchors, windows and texts that occur again, the most common ones are marked by a broadcast list, without a
shuffle; only the others are joined by hash. Texts are told apart by 128 bits of id and content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.llm.bytesops import BYTE_VALUES, U64, blocks, column_bytes, gram_hash, mix, prefix_hash
from drawlake.llm.common import heavy_keys, materialize, skewed_join

GRAM = 64
HOT = 50_000
STEP = 8
_PLACE = U64((1 << 30) - 1)
_SPANS = "array<struct<start:int,end:int>>"


def window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, U64)
    padded[: len(keys)] = keys
    grid = padded.reshape(-1, width)
    front = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], front[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """For each text of a block: anchor hashes, their offsets, and spans settled as periodic."""
    width = length - GRAM + 1
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int32), [])
    if len(data) < length:
        return [empty] * (len(starts) - 1)
    hashed = mix(gram_hash(prefix_hash(BYTE_VALUES[data]), GRAM))
    keys = (hashed & ~_PLACE) | np.arange(len(hashed), dtype=U64)
    chosen = (window_minimum(keys, width) & _PLACE).astype(np.int64)
    out = []
    for a, b in zip(starts[:-1], starts[1:] - 1):
        if b - a < length:
            out.append(empty)
            continue
        own = chosen[a : b - length + 1]
        at = own[np.flatnonzero(np.diff(own, prepend=-1))]
        value = hashed[at]
        spans, keep = [], np.ones(len(at), bool)
        edges = np.flatnonzero(np.diff(value)) + 1
        for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(at)]):
            if hi - lo < 4:
                continue
            gap = np.diff(at[lo:hi])
            d, end = int(gap[0]), int(at[hi - 1]) + GRAM
            first = int(at[lo])
            if (gap == d).all() and end - first >= length + 2 * d and (data[first : end - d] == data[first + d : end]).all():
                spans.append((first - int(a), end - int(a)))
                keep[lo + 1 : hi] = at[lo + 1 : hi] > end - length - d
        out.append((value[keep].view(np.int64), (at[keep] - a).astype(np.int32), spans))
    return out


def _list(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind))


def _mark(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, places, spans, digests, sizes = [], [], [], [], []
            for _, _, data, starts in blocks(batch.column(1)):
                for (h, p, s), a, b in zip(anchors(data, starts, length), starts[:-1], starts[1:] - 1):
                    hashes.append(h)
                    places.append(p)
                    spans.append(s)
                    digests.append(hashlib.blake2b(data[a:b].tobytes(), digest_size=16).digest())
                    sizes.append(b - a)
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), _list(hashes, pa.int64()), _list(places, pa.int32())]
            local = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*columns, local], ["uid", "digest", "n_bytes", "hashes", "places", "local"])

    return run


def _contexts(length: int):
    before = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "uid", "places", "left", "right"]
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary())
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            uids = batch.column(0).to_pylist()
            rows = [[] for _ in names]
            for i, marks in enumerate(batch.column(2)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                found: dict[tuple[int, bytes, bytes], list[int]] = {}
                for m in marks.as_py():
                    p = m["place"]
                    found.setdefault((m["hash"], text[max(0, p - before) : p], text[p : p + length]), []).append(p)
                for (value, left, right), places in found.items():
                    for column, item in zip(rows, (value, uids[i], places, left, right)):
                        column.append(item)
                if len(rows[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)
                    rows = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)

    return run


def _matrix(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts], np.int64)
    grid = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(-1, width)
    return grid, size


def _shared(grid: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b."""
    differ = grid[a] != grid[b]
    n = np.where(differ.any(1), differ.argmax(1), grid.shape[1])
    return np.minimum(n, np.minimum(size[a], size[b]))


def extents(hashes: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest extension of each occurrence to the left and right within repeats of ``length`` bytes or more; 0, 0 if none.

    Occurrences with equal hashes are compared with one another; contexts must be distinct within a hash.
    """
    order = sorted(range(len(hashes)), key=lambda i: (hashes[i], rights[i]))
    n = len(order)
    best_l, best_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return best_l, best_r
    key = hashes[order]
    grid, size = _matrix([rights[i] for i in order], length)
    back, back_size = _matrix([lefts[i][::-1] for i in order], length)
    place = np.empty(n, np.int64)  # rank by reversed left context
    place[sorted(range(n), key=lambda i: lefts[order[i]][::-1])] = np.arange(n)
    pairs = np.arange(n - 1)
    common = np.concatenate([_shared(grid, size, p, p + 1) for p in np.array_split(pairs, max(1, n // 20_000))])
    common[key[1:] != key[:-1]] = -1

    def visit(prefix: int, lo: int, hi: int) -> None:
        need = max(0, length - prefix)
        members = np.arange(lo, hi)
        members = members[back_size[lo:hi] >= need]
        if len(members) < 2:
            return
        members = members[np.argsort(place[members])]
        a, b = members[:-1], members[1:]
        left = _shared(back, back_size, a, b)
        good = left >= need
        for m in (a[good], b[good]):
            np.maximum.at(best_l, m, left[good])
            best_r[m] = np.maximum(best_r[m], prefix)

    stack: list[tuple[int, int]] = []
    for i in range(1, n + 1):
        c = int(common[i - 1]) if i < n else -1
        lo = i - 1
        while stack and stack[-1][0] > c:
            prefix, lo = stack.pop()
            visit(prefix, lo, i)
        if c >= GRAM and (not stack or stack[-1][0] < c):
            stack.append((c, lo))
    out_l, out_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out_l[order], out_r[order] = best_l, best_r
    return out_l, out_r


def _scan(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        context = pd.MultiIndex.from_frame(rows[["hash", "left", "right"]])
        code, unique = pd.factorize(context)
        times = rows["places"].map(len).to_numpy()
        count = np.bincount(code, times)
        hashes = np.array([u[0] for u in unique], np.int64)
        lefts, rights = [u[1] for u in unique], [u[2] for u in unique]
        l, r = extents(hashes, lefts, rights, length)
        whole = (count > 1) & (np.array([len(a) + len(b) for a, b in zip(lefts, rights)]) >= length)
        l = np.where(whole, [len(x) for x in lefts], l)[code]
        r = np.where(whole, [len(x) for x in rights], r)[code]
        l, r, uid = (np.repeat(x, times) for x in (l, r, rows["uid"].to_numpy()))
        hit = (l + r) >= length
        place = np.concatenate(rows["places"].to_list())
        return pd.DataFrame({"uid": uid[hit], "start": (place - l)[hit], "end": (place + r)[hit]})

    return run


def _again(contexts: DataFrame, reaches: F.Column, length: int) -> DataFrame:
    """``uid, places, reach`` of the strings of ``length`` bytes that start ``reach`` bytes before an anchor, if they occur again."""
    rows = contexts.withColumn("whole", F.concat("left", "right")).withColumn("reach", F.explode(reaches))
    first = F.octet_length("left") - F.col("reach")
    rows = rows.where((first >= 0) & (first + length <= F.octet_length("whole")))
    window = F.concat(F.encode(F.concat(F.col("reach").cast("string"), F.lit(":")), "UTF-8"), F.substring(F.col("whole"), first + 1, F.lit(length)))
    rows = rows.select("uid", "places", "reach", F.unhex(F.md5(window)).alias("window"))
    many = materialize(rows.groupBy("window").agg(F.sum(F.size("places")).alias("n")).where("n > 1"), "windows")
    return skewed_join(rows, many.select("window"), "window", heavy_keys(many, "window", "n"), "left_semi").select("uid", "places", "reach")


def _hot_extents(contexts: DataFrame, length: int) -> DataFrame:
    """Extents of occurrences of very common anchors, by counting each window through the anchor.

    A window holds the string that is ``STEP`` bytes shorter and starts at the next smaller multiple of ``STEP``
    before the anchor, so only windows around strings that occur again are counted.
    """
    around = _again(contexts, F.sequence(F.lit(0), F.octet_length("left"), F.lit(STEP)), length - STEP)
    around = around.groupBy("uid", "places").agg(F.collect_list("reach").alias("around"))
    contexts = materialize(contexts.join(around, ["uid", "places"]), "around")
    each = F.flatten(F.transform("around", lambda r: F.sequence(r, r + STEP - 1)))
    found = _again(contexts, each, length).groupBy("uid", "places").agg(F.max("reach").alias("most"), F.min("reach").alias("least")).withColumn("place", F.explode("places"))
    return found.select("uid", (F.col("place") - F.col("most")).cast("long").alias("start"), (F.col("place") - F.col("least") + length).cast("long").alias("end"))


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            whole, spans = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = [[] for _ in range(5)]
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                runs: list[list[int]] = [[0, len(text)]] if whole[i] and len(text) else []
                for s in sorted((s["start"], s["end"]) for s in spans[i] or []) if not runs else []:
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                keep = np.ones(len(text), bool)
                for s, e in runs:
                    keep[s:e] = False
                kept = text[keep].tobytes()
                for column, value in zip(out, (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_text else None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, with_text: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept], repeated)`` for each row.

    Null text is empty. Repeated rows are copies of one another, so their texts go if long enough. A null
    doc_id is allowed, and rows may share a doc_id; texts are judged by content. Texts shorter than ``length``
    lose nothing, very long ones are treated whole, no rows give no rows. Other columns are ignored, whatever
    their names. ``length`` must be greater than 64.
    """
    if length <= GRAM:
        raise ValueError(f"length must exceed {GRAM}")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    uid = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")))).alias("uid")
    marked = materialize(read.select(uid, "text").mapInArrow(_mark(length), f"uid binary, digest binary, n_bytes long, hashes array<long>, places array<int>, local {_SPANS}"), "marked")
    classes = marked.groupBy("digest").agg(F.min("uid").alias("uid"), F.count("*").alias("copies"), F.first("hashes").alias("hashes"), F.first("places").alias("places"))
    each = classes.select("uid", "copies", F.explode(F.arrays_zip("hashes", "places")).alias("m")).select("uid", "copies", F.col("m.hashes").alias("hash"), F.col("m.places").alias("place"))
    each = materialize(each, "anchors")
    common = each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    common = materialize(common, "common")
    wanted = skewed_join(each, common.select("hash"), "hash", heavy_keys(common, "hash", "n"), "left_semi").groupBy("uid").agg(F.collect_list(F.struct("hash", "place")).alias("marks"))
    texts = read.select(uid, "text").join(wanted, "uid")
    found = texts.mapInArrow(_contexts(length), "hash long, uid binary, places array<int>, left binary, right binary")
    hot = materialize(common.where(F.col("n") > HOT).select("hash"), "hot")
    groups = max(64, each.count() // 4000)
    if not hot.isEmpty():
        found = materialize(found, "contexts")
        hot = materialize(found.join(hot, "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("hash"), "hot")
    if hot.isEmpty():
        cool, rest = found, []
    else:
        cool, rest = found.join(hot, "hash", "left_anti"), [_hot_extents(found.join(hot, "hash", "left_semi"), length)]
    spans = cool.groupBy(F.pmod("hash", F.lit(groups)).alias("g")).applyInPandas(_scan(length), "uid binary, start long, end long")
    for more in rest:
        spans = spans.unionByName(more)
    local = marked.select("uid", F.explode("local").alias("s")).select("uid", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))
    copied = materialize(classes.where("copies > 1").select("digest", "copies"), "copied")
    whole = skewed_join(marked.where(F.col("n_bytes") >= length).select("digest", "uid"), copied.select("digest"), "digest", heavy_keys(copied, "digest", "copies"), "left_semi").select("uid").distinct().select("uid", F.lit(True).alias("whole"))
    spans = spans.unionByName(local).groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    cut = materialize(spans.join(whole, "uid", "full").select("uid", F.coalesce("whole", F.lit(False)).alias("whole"), F.when(F.col("whole").isNull(), F.col("spans")).alias("spans")), "spans")
    out = read.withColumn("uid", uid).join(cut, "uid", "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")
    out = out.mapInArrow(_cut(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumn("repeated", F.col("n_spans") > 0)
    return out if with_text else out.drop("kept")
