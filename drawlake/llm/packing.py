"""Sequence packing by cutting-stock column generation.

Each document becomes token ids ended by one separator id and is cut into full pieces of the capacity
and one remainder. Remainder lengths are rounded up to a small number of length classes; the
histogram over classes is all that reaches the driver. There a linear program over patterns (how many
pieces of each class fill one sequence) is solved by column generation: the master program prices the
classes, a knapsack dynamic program finds the pattern worth most, until none is worth more than one
sequence. Pattern counts are rounded down, what is left over is packed by first fit decreasing on the
histogram, so the patterns cover the counts exactly. Pieces are ranked within their class and mapped to
pattern, sequence and slot by rank; offsets follow from true lengths.

Scale. Ranks come from counts per written partition, so no class is ordered in one task. The driver
holds at most 2 * capacity / step numbers whatever the corpus. A task holds one batch of texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlake.llm.common import materialize

#: Characters for which both tokenizer libraries split words alike; any other text goes to the slower, defining one.
PLAIN_LIMIT = 0x250


class Encoder:
    """Token ids of the vocabulary file ``path`` (byte-level BPE, tokenizers format), special tokens not added.

    ``ranks`` may name the same vocabulary as a rank file. Texts of Latin characters are then encoded from
    it, several times faster, with equal ids; all others by the tokenizers library itself.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        if ranks and pattern:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast and (text.isascii() or ord(max(text)) < PLAIN_LIMIT) and not any(t in text for t in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


_encoders: dict[tuple, Encoder] = {}


def encoder(*key: str | None) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _pieces(key: tuple, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*key)
        for batch in batches:
            rows, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                tokens = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for at in range(0, len(tokens), capacity):
                    piece = tokens[at : at + capacity]
                    rows.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(tokens))
                    if with_ids:
                        ids.append(piece.astype(np.int64))
            kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
            out = [*kept, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = [*batch.schema.names[:-1], "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                out, names = [*out, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _price(values: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """Unbounded knapsack: how many of each class are worth most within ``room`` units."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    worth, number = np.full(room + 1, -1.0), np.full(room + 1, -1)
    worth[sizes], number[sizes] = values, np.arange(len(sizes))
    for c in range(1, room + 1):
        gain = worth[1 : c + 1] + best[c - 1 :: -1]  # a piece of size s, and the best of the room it leaves
        k = int(gain.argmax())
        best[c] = best[c - 1]
        if gain[k] > best[c] + 1e-12:
            best[c], choice[c] = gain[k], k + 1
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
            continue
        pattern[number[choice[c]]] += 1
        c -= choice[c]
    return pattern


def patterns_for(counts: dict[int, int], room: int, rounds: int = 20_000, gap: float = 1e-4, smooth: float = 0.8) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) that use each class exactly as often as ``counts`` says; sizes and room in units.

    Prices are smoothed towards those that gave the best lower bound so far. Generation ends when the program's
    value is within the share ``gap`` of the bound, or no pattern is worth more than one sequence.
    """
    classes = sorted((s for s, n in counts.items() if n), reverse=True)
    if not classes:
        return []
    sizes, need = np.array(classes), np.array([counts[s] for s in classes], float)
    m = len(classes)
    columns = [np.eye(m, dtype=np.int64)[i] * (room // sizes[i]) for i in range(m)]
    basis = np.array(columns, float).T
    inverse = np.diag(1 / np.diag(basis))
    used = inverse @ need
    bound, centre = 0.0, None
    for _ in range(rounds):
        prices = inverse.sum(0)  # every pattern costs one sequence
        for asked in [prices] if centre is None else [smooth * centre + (1 - smooth) * prices, prices]:
            pattern = _price(asked, sizes, room)
            worth = max(1.0, float(asked @ pattern))
            if asked @ need / worth > bound:
                bound, centre = asked @ need / worth, asked / worth
            if prices @ pattern > 1 + 1e-9:
                break
        if prices @ pattern <= 1 + 1e-9 or used.sum() <= bound * (1 + gap):
            break
        column = inverse @ pattern
        ratio = np.where(column > 1e-11, used / np.where(column > 1e-11, column, 1), np.inf)
        out = int(ratio.argmin())
        columns[out] = pattern
        step = ratio[out]
        used = used - step * column
        used[out] = step
        pivot = inverse[out] / column[out]
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
    plan, left = [], need.astype(np.int64)
    for times, column in zip(used, columns):
        n = int(np.floor(times + 1e-6))
        n = min([n, *(left[column > 0] // column[column > 0])])
        if n > 0:
            plan.append(({int(sizes[i]): int(column[i]) for i in np.flatnonzero(column)}, n))
            left = left - n * column
    bins: list[tuple[int, dict[int, int]]] = []
    for size, n in zip(sizes, left):
        for _ in range(int(n)):
            at = next((i for i, (free, _) in enumerate(bins) if free >= size), None)
            free, held = bins.pop(at) if at is not None else (room, {})
            held[int(size)] = held.get(int(size), 0) + 1
            bins.insert(at if at is not None else len(bins), (free - int(size), held))
    return plan + [(held, 1) for _, held in bins]


def pack(docs: DataFrame, key: tuple, capacity: int = 2048, end_id: int = 1, step: int = 8, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """One row per piece: ``keep``, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    ``key`` is (vocabulary file, rank file or None, split pattern or None). Null and empty texts hold only
    the separator; repeated rows are packed each, very long texts are encoded and cut whole, no rows give no rows.
    Columns that are not kept are ignored.
    """
    if capacity % step:
        raise ValueError("capacity must be a multiple of step")
    read = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1])
    cut = read.mapInArrow(_pieces(key, capacity, end_id, with_ids), f"{kinds}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids)
    cut = cut.withColumn("class", F.ceil(F.col("length") / step).cast("int")).withColumn("part", F.spark_partition_id())
    pieces = materialize(cut, "pieces")

    held = materialize(pieces.groupBy("class", "part").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    counts = {r["class"]: r["n"] for r in held.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    full = capacity // step
    plan = [({full: 1}, counts.pop(full))] if full in counts else []
    plan += patterns_for(counts, full)

    # one line per pattern and class: at most a few thousand, as classes are bounded
    lines, sequence, seen = [], 0, {}
    for pattern, times in plan:
        at = 0
        for size in sorted(pattern, reverse=True):
            first = seen.get(size, 0)
            lines.append((size, first, first + pattern[size] * times, pattern[size], sequence, at))
            seen[size] = first + pattern[size] * times
            at += pattern[size]
        sequence += times
    spark = docs.sparkSession
    table = spark.createDataFrame(lines or [(-1, 0, 0, 1, 0, 0)], "class int, first long, last long, per long, sequence long, slot long")
    local = Window.partitionBy("class", "part").orderBy(*keep, "start", "ids_crc32")
    ranked = pieces.withColumn("local", F.row_number().over(local) - 1).join(F.broadcast(shift), ["class", "part"]) if held.count() <= 1 << 17 else pieces.withColumn("local", F.row_number().over(local) - 1).join(shift, ["class", "part"])
    ranked = ranked.withColumn("rank", F.col("local") + F.col("shift"))
    t = F.broadcast(table.withColumnRenamed("class", "size"))
    placed = ranked.join(t, (F.col("class") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    nth = F.col("rank") - F.col("first")
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor(nth / F.col("per")).cast("long")).withColumn("slot", F.col("slot") + nth % F.col("per"))
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
    return out.select(*keep, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
