"""Ranked lexical search, reversed: documents stream through an inverted index of the items' terms.

The items are few and the documents many, so the items are indexed and broadcast, in blocks of bounded bytes. One pass
counts, for each document, its terms and those that some item has; the result is written, as numbers only. From it come
the corpus statistics (documents, terms, documents with a term), added up in the tasks first, and then the scores: a
batch of documents is a matrix of items by documents, to which each term adds what it is worth in its documents for
its items. Each task keeps the k best documents of each item and gives them out at its end; these
heaps are merged by item and part, and then by item.

Scale. Texts are read once for each block of items, and never shuffled; shuffled are at most k rows an item and task.
A term is compared by its bytes. Scores are 64-bit integers, so their order does not depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlake.llm.bytesops import LOWER, U64, blocks, mix, packed
from drawlake.llm.common import materialize, union_all

#: The bytes that stand in no term.
TERM = np.ones(256, bool)
TERM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
#: Most cells of a matrix of items by documents.
CELLS = 1 << 22
PARTS = 32
NO_ID = np.iinfo(np.int64).max


def term_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of a block that ends with a space."""
    edge = np.flatnonzero(np.diff(TERM[data].view(np.int8), prepend=0))
    return edge[::2], edge[1::2]


class Terms:
    """The numbers of the terms of some texts; compared byte by byte."""

    def __init__(self, texts: list[str]):
        found: dict[bytes, int] = {}
        self.of_text: list[list[int]] = []
        for _, _, data, starts in blocks(pa.array(texts, pa.string())):
            data = LOWER[data]
            begin, end = term_bounds(data)
            raw = data.tobytes()
            numbers = [found.setdefault(raw[a:b], len(found)) for a, b in zip(begin.tolist(), end.tolist())]
            cut = np.searchsorted(begin, starts).tolist()
            self.of_text += [sorted(set(numbers[a:b])) for a, b in zip(cut[:-1], cut[1:])]
        self.count = len(found)
        size = np.array([len(t) for t in found], np.int64)
        low, high, short = packed(np.frombuffer(b"".join(found), np.uint8), np.cumsum(size) - size, size)
        self.long = {t: i for t, i in found.items() if not short[i]}
        self.seed, number = 0, np.flatnonzero(short)
        while len(np.unique(key := self._key(low[number], high[number]))) < len(number):
            self.seed += 1
        order = np.argsort(key)
        self.key, self.number = key[order], number[order]
        self.low, self.high = low[self.number], high[self.number]

    def _key(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix(low ^ mix(high + U64(self.seed)))

    def find(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for unknown ones."""
        out = np.full(len(begin), -1, np.int64)
        low, high, short = packed(data, begin, end - begin)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, self._key(low, high)), len(self.key) - 1)
            same = short & (self.low[at] == low) & (self.high[at] == high)
            out[same] = self.number[at[same]]
        if self.long:
            for i in np.flatnonzero(~short):
                out[i] = self.long.get(data[begin[i] : end[i]].tobytes(), -1)
        return out


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for batch in batches:
            for a, b, data, starts in blocks(batch.column(1)):
                data = LOWER[data]
                begin, end = term_bounds(data)
                edge = np.searchsorted(begin, starts)
                number = terms.find(data, begin, end)
                row = np.repeat(np.arange(b - a), np.diff(edge))
                known = number >= 0
                pair, tf = np.unique(row[known] * max(terms.count, 1) + number[known], return_counts=True)
                row, number = pair // max(terms.count, 1), pair % max(terms.count, 1)
                cut = np.searchsorted(row, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(edge)), _lists(cut, number), _lists(cut, tf)], ["doc_id", "n", "terms", "tf"])

    return run


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)


def _statistics(terms: int):
    """Of each task: documents by term, and documents and terms in all under -1 and -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs, words = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            n = batch.column(0).to_numpy()
            docs, words = docs + int((n > 0).sum()), words + int(n.sum())
            total += np.bincount(_flat(batch.column(1))[1], minlength=terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-1, -2])), pa.array(np.append(total[held], [docs, words]))], ["term", "n"])

    return run


def best(item: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the k best of each item, best first, and their places from 0."""
    order = np.lexsort((ids, -score, item))
    item = item[order]
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    return order[rank < k], rank[rank < k]


def _score(shared, k: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        items = at["items"]
        top, top_id = np.zeros((items, k), np.int64), np.full((items, k), NO_ID)
        step = max(1, cells // max(items, 1))
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy()
            offsets, term = _flat(batch.column(2))
            _, tf = _flat(batch.column(3))
            row = np.repeat(np.arange(len(n)), np.diff(offsets))
            m = 10 + 90 * n * at["docs"] // max(at["words"], 1)
            worth = at["weight"][term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
            for a in range(0, len(n), step):
                b = min(a + step, len(n))
                own = slice(offsets[a], offsets[b])
                order = np.argsort(term[own], kind="stable")
                t, d, w = term[own][order], row[own][order] - a, worth[own][order]
                score = np.zeros((items, b - a), np.int64)
                cuts = np.flatnonzero(np.diff(t, prepend=-1, append=-1))
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    which = at["posting"][at["first"][t[x]] : at["first"][t[x] + 1]]
                    score[which[:, None], d[x:y]] += w[x:y]
                floor = np.maximum(top[:, -1], 1)
                if b - a > k:
                    floor = np.maximum(floor, np.partition(score, b - a - k, axis=1)[:, b - a - k])
                item, doc = np.nonzero(score >= floor[:, None])
                item_all = np.append(item, np.repeat(np.arange(items), k))
                score_all, id_all = np.append(score[item, doc], top), np.append(ids[a:b][doc], top_id)
                kept, rank = best(item_all, score_all, id_all, k)
                top[item_all[kept], rank], top_id[item_all[kept], rank] = score_all[kept], id_all[kept]
        item, place = np.nonzero(top > 0)
        found = top_id[item, place]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(found, mask=found == NO_ID), pa.array(top[item, place])], ["item", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, items: list[tuple[int | None, str]], k: int, cells: int) -> DataFrame:
    """``search`` for items that the driver holds."""
    spark = docs.sparkSession
    terms = Terms([t for _, t in items])
    counted = docs.mapInArrow(_count(spark.sparkContext.broadcast(terms)), "doc_id long, n long, terms array<int>, tf array<int>")
    counted = materialize(counted, "counts")
    partial = counted.select("n", "terms").mapInArrow(_statistics(terms.count), "term long, n long")
    found = {r["term"]: r["n"] for r in partial.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = found.get(-1, 0)
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * found.get(t, 0) + 1))) for t in range(terms.count)]
    of_term = np.array([t for own in terms.of_text for t in own], np.int64)
    of_item = np.repeat(np.arange(len(items)), [len(own) for own in terms.of_text])
    order = np.argsort(of_term, kind="stable")
    index = {"items": len(items), "docs": n, "words": found.get(-2, 0), "weight": np.array(weight, np.int64), "posting": of_item[order], "first": np.searchsorted(of_term[order], np.arange(terms.count + 1))}
    heaps = counted.where(F.size("terms") > 0).mapInArrow(_score(spark.sparkContext.broadcast(index), k, cells), "item long, doc_id long, score long")
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item long, item_id long")
    by = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    part = Window.partitionBy("item", "part").orderBy(*by)
    heaps = heaps.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).withColumn("place", F.row_number().over(part)).where(F.col("place") <= k)
    ranked = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 8 << 20, cells: int = CELLS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best of ``docs(doc_id, text, ...)`` for each of ``items(item_id, text, ...)``.

    Only scores above 0 count; equal ones are ranked by ascending doc_id, null ids last. Null and empty texts have no
    terms: as documents they count for nothing, as items they find nothing. Very long texts are taken whole. Repeated
    documents are ranked each; equal rows of ``items`` count once, different texts of one item_id are items each, and so
    is one with a null id. Without documents or items there are no rows. Other columns are ignored, whatever
    their names. ``block_bytes`` bounds the texts of the items that are indexed at once, ``cells`` a
    task's matrix of items by documents.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts, found = max(1, -(-size // block_bytes)), []
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        if own or part == 0:
            found.append(_search_block(read, [tuple(r) for r in own], k, cells))
    return union_all(found)
