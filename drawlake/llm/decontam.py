"""Benchmark decontamination by template canonicalisation.

Texts become token templates: numbers, names (capitalised inside a sentence) and units after a number turn
into typed placeholders, runs of one placeholder into one; other words are lower-cased and stripped of
marks. A capitalised word that opens a sentence may be a name or a plain word: windows over it are formed
under both readings (as a name it also takes up the names that follow it), on both sides. Windows of five
template tokens of the benchmark are joined by hash with those of the documents. A document's windows that
match an item are aligned, and the values in their slots must map one to one (each benchmark value always to
the same document value); windows that break the mapping do not count, and a window counts if one of its
readings keeps it. A document is contaminated by an item if it holds ``share`` or more of the item's windows,
or a run of ``run_words`` words of it. So re-parameterised questions are caught as well as copies.

Scale. The benchmark's windows are broadcast as a sorted table of hashes (17 bytes each reading; two readings
for each opening word in it), in blocks of at most ``block_windows`` windows, and looked up by binary search; a
benchmark beyond that is joined block by block, over documents written once with a number for each row.
Documents are not shuffled; their windows are formed and looked up ``STARTS`` places at a time. A window that
many items share is first only counted for each of them, ``PAIRS`` pairs at a time, and matched with those
that enough other windows hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlake.llm.bytesops import BYTE_VALUES, LOWER, U64, blocks, mix, prefix_hash, range_hash, word_bounds
from drawlake.llm.common import materialize, union_all

WINDOW = 5
STARTS = 1 << 16
PAIRS = 1 << 18
#: Unit words, fixed values.
UNITS = "mm cm m km in ft mi g kg mg lb oz l ml s sec min h hours hour minutes minute seconds days day years year percent dollars euros usd eur mph kmh c f".split()
_MARKS = np.arange(256, dtype=np.uint8)
_MARKS[[c for c in range(128) if not chr(c).isalnum()]] = 0x20
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_NUM, _NAME, _UNIT = (mix(np.array([x], U64))[0] for x in (101, 102, 103))


def _lower(data: np.ndarray) -> np.ndarray:
    out = LOWER[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[latin] += 0x20
    return out


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer((" ".join(UNITS) + " ").encode(), np.uint8)
    return np.sort(mix(range_hash(prefix_hash(BYTE_VALUES[data]), *word_bounds(data))))


_UNIT_HASHES = _unit_hashes()


def templates(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, slot value or 0, bounds of each text's tokens, bytes of each token's end) of a block.

    A capitalised word that opens a sentence stands as plain word with the slot value of a name.
    """
    low = _lower(data)
    begin, end = word_bounds(_MARKS[low])
    word = mix(range_hash(prefix_hash(BYTE_VALUES[low]), begin, end))
    count = lambda x: np.concatenate([[0], np.cumsum(x)])
    digits = count(_DIGIT[data])
    number = digits[end] > digits[begin]
    raised = count(low != data)
    capital = (raised[np.minimum(begin + 2, end)] > raised[begin]) & (raised[end] - raised[begin] <= 1) & (end - begin > 1)
    stops = count(_STOP[data])
    previous = np.concatenate([[0], end[:-1]])
    opening = stops[begin] > stops[previous]
    first = np.searchsorted(begin, starts[:-1])
    opening[first[first < len(begin)]] = True
    name = capital & ~opening & ~number
    after = np.zeros(len(begin), bool)
    after[1:] = number[:-1]
    after[first[first < len(begin)]] = False
    unit = after & np.isin(word, _UNIT_HASHES) & ~number
    token = np.where(number, _NUM, np.where(name, _NAME, np.where(unit, _UNIT, word)))
    slot = np.where(number | capital, word | U64(1), U64(0))
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | ~(number | name)[1:]
    keep[first[first < len(keep)]] = True
    kept = np.flatnonzero(keep)
    return token[kept], slot[kept], np.searchsorted(begin[kept], starts), end[kept]


def _either(token: np.ndarray, slot: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a token may be plain word or name, and whether it is left out if the one before it is read as a name."""
    either = (slot != 0) & (token != _NUM) & (token != _NAME)
    after = np.zeros(len(token) + 1, bool)
    after[1:] = either
    after[bounds] = False
    return either, after[:-1] & (token == _NAME)


def windows(token: np.ndarray, slot: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first token, hash, reading) of all windows of a block's texts, ``STARTS`` places at a time; bit k of a reading: its token k is an opening word read as a name."""
    either, joined = _either(token, slot, bounds)
    joined = np.append(joined, False)
    stop = np.repeat(bounds[1:], np.diff(bounds))
    for low in range(0, len(token), STARTS):
        start = np.arange(low, min(low + STARTS, len(token)))
        at, key, reading = start, np.zeros(len(start), U64), np.zeros(len(start), np.uint8)
        for k in range(WINDOW):
            inside = at < stop[start]
            start, at, key, reading = start[inside], at[inside], key[inside], reading[inside]
            factor = U64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1)
            two = np.flatnonzero(either[at])
            key, as_name = key + token[at] * factor, key[two] + np.full(len(two), _NAME) * factor
            start, key, reading = np.append(start, start[two]), np.append(key, as_name), np.append(reading, reading[two] | np.uint8(1 << k))
            at = np.append(at + 1, at[two] + 1 + joined[at[two] + 1])
        yield start, mix(key), reading


def _places(at: int, reading: int, either: np.ndarray, joined: np.ndarray) -> tuple[list[tuple[int, bool]], list[int]]:
    """(token, whether its slot counts) of a window, and the tokens it leaves out."""
    out, gone = [], []
    for k in range(WINDOW):
        as_name = bool(reading >> k & 1)
        out.append((at, as_name or not either[at]))
        at += 1
        if as_name and at < len(joined) and joined[at]:
            gone.append(at)
            at += 1
    return out, gone


def _index(items: list[tuple[int, str]]) -> dict:
    """Sorted window hashes of the items with item, place and reading, and each item's slots."""
    hashes, owner, place, reading, slots, either, joined, size = [], [], [], [], [], [], [], []
    for _, _, data, starts in blocks(pa.array([t or "" for _, t in items], pa.string())):
        token, slot, bounds, _ = templates(data, starts)
        for start, key, read in windows(token, slot, bounds):
            text = np.searchsorted(bounds, start, "right") - 1
            hashes.append(key)
            owner.append((text + len(size)).astype(np.int32))
            place.append((start - bounds[text]).astype(np.int32))
            reading.append(read)
        for out, x in zip((slots, either, joined), (slot, *_either(token, slot, bounds))):
            out += [x[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        size += [max(int(n) - WINDOW + 1, 0) for n in np.diff(bounds)]
    hashes, owner, place, reading = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, U64), (owner, np.int32), (place, np.int32), (reading, np.uint8)))
    order = np.argsort(hashes, kind="stable")
    return {"hash": hashes[order], "owner": owner[order], "place": place[order], "reading": reading[order], "slots": slots, "either": either, "joined": joined, "size": np.array(size, np.int64), "may": np.array([int(x.sum()) for x in joined], np.int64), "ids": [i for i, _ in items]}


def _aligned(match: list[tuple[int, int, int, int]], doc: tuple, item: tuple) -> tuple[set[int], set[int], bool]:
    """Item places held by (document place, item place, readings of both) rows that keep a one-to-one slot mapping, item tokens left out by them, and whether any value was changed."""
    forth: dict[int, int] = {}
    back: dict[int, int] = {}
    held, gone, seen, changed = set(), set(), set(), False
    # last those that start behind an opening word that may belong to the same name; of one place the readings with fewer names come first
    for p, q, doc_reading, item_reading in sorted(match, key=lambda m: int(doc[2][m[0]]) + int(item[2][m[1]])):
        if (p, q) in seen:
            continue
        left, _ = _places(p, doc_reading, *doc[1:])
        right, out = _places(q, item_reading, *item[1:])
        here = [(int(item[0][j]) * jn, int(doc[0][i]) * n) for (i, n), (j, jn) in zip(left, right)]
        here = [x for x in here if x != (0, 0)]
        f, b = {}, {}
        if any(forth.get(x, f.setdefault(x, y)) != y or back.get(y, b.setdefault(y, x)) != x for x, y in here):
            continue
        forth.update(f)
        back.update(b)
        changed |= any(x != y for x, y in here)
        seen.add((p, q))
        held.add(q)
        gone.update(out)
    return held, gone, changed


def _chunks(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of windows with about ``PAIRS`` pairs each."""
    upto = np.cumsum(hi - lo)
    edges = np.unique(np.r_[0, np.searchsorted(upto, np.arange(PAIRS, upto[-1] if len(upto) else 0, PAIRS), "right"), len(lo)])
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def _pairs(lo: np.ndarray, hi: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, row of the index) for the windows a to b."""
    n = hi[a:b] - lo[a:b]
    rows = np.repeat(np.arange(a, b), n)
    return rows, np.repeat(lo[a:b] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(rows))


def judge(hits: tuple[np.ndarray, np.ndarray, np.ndarray], doc: tuple, index: dict, share: float, run_words: int) -> list[tuple[int, float, bool]]:
    """(item number, share of its windows, re-parameterised) for the items that contaminate a text, by its windows that match: (first token, hash, reading)."""
    start, key, read = hits
    lo, hi = np.searchsorted(index["hash"], key, "left"), np.searchsorted(index["hash"], key, "right")
    chunks = _chunks(lo, hi)
    enough = None
    if len(chunks) > 1:
        # no item can contaminate the text of which fewer windows are hit than it needs, however often each
        hits_of = np.zeros(len(index["size"]), np.int64)
        for a, b in chunks:
            np.add.at(hits_of, index["owner"][_pairs(lo, hi, a, b)[1]], 1)
        enough = hits_of >= np.minimum(share * (index["size"] - index["may"]), run_words - WINDOW + 1 - index["may"])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in chunks:
        rows, at = _pairs(lo, hi, a, b)
        keep = slice(None) if enough is None else enough[index["owner"][at]]
        found.append((rows[keep], at[keep]))
    rows, at = (np.concatenate(x) for x in zip(*found))
    owner, place = index["owner"][at], index["place"][at]
    names = np.bitwise_count(read[rows]) + np.bitwise_count(index["reading"][at])
    out = []
    for item in np.unique(owner):
        own = np.flatnonzero(owner == item)
        p, q = start[rows[own]], place[own]
        total = index["size"][item]
        may = index["may"][item]  # a token left out takes its place with it
        if len(np.unique(q)) < min(share * (total - may), run_words - WINDOW + 1 - may):
            continue
        best, changed = 0.0, False
        # copies at different places of the text are judged each by its own mapping
        shift = p - q
        own = own[np.lexsort((names[own], p, shift))]
        p, q = start[rows[own]], place[own]
        shift = p - q
        match = list(zip(p.tolist(), q.tolist(), read[rows[own]].tolist(), index["reading"][at[own]].tolist()))
        cuts = [0, *(np.flatnonzero(np.diff(shift) > 2 * WINDOW) + 1).tolist(), len(match)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            places, gone, differs = _aligned(match[a:b], doc, (index["slots"][item], index["either"][item], index["joined"][item]))
            if not places:
                continue
            kept = np.array(sorted(places | gone))
            runs = np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1)
            longest = max(len(r) for r in runs) + WINDOW - 1
            held = min(1.0, len(places - gone) / max(1, total - len(gone)))
            if held >= share or longest >= run_words:
                if held > best:
                    best, changed = held, differs
        if best:
            out.append((int(item), best, changed))
    return out


def _hits(token: np.ndarray, slot: np.ndarray, bounds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, hash, reading) of a block's windows that stand in the index, by first token."""
    found = [(np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.uint8))]
    if len(hashes):
        for part in windows(token, slot, bounds):
            here = hashes[np.minimum(np.searchsorted(hashes, part[1]), len(hashes) - 1)] == part[1]
            found.append(tuple(x[here] for x in part))
    start, key, reading = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(start, kind="stable")
    return start[order], key[order], reading[order]


def _judged(column: pa.Array, index: dict, share: float, run_words: int) -> tuple[list[list], list[float], list[bool]]:
    """(ids of the items found, largest share, re-parameterised) of each text."""
    items, shares, changed = [], [], []
    for _, _, data, starts in blocks(column):
        token, slot, bounds, _ = templates(data, starts)
        hits = _hits(token, slot, bounds, index["hash"])
        doc = (slot, *_either(token, slot, bounds))
        edge = np.searchsorted(hits[0], bounds)
        for a, b in zip(edge[:-1], edge[1:]):
            found = judge(tuple(x[a:b] for x in hits), doc, index, share, run_words) if a < b else []
            items.append([index["ids"][i] for i, _, _ in found])
            shares.append(max((s for _, s, _ in found), default=0.0))
            changed.append(any(c for _, _, c in found))
    return items, shares, changed


def _probe(shared, share: float, run_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, shares, changed = _judged(batch.column(2), shared.value, share, run_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, pa.list_(pa.int64())), pa.array(shares, pa.float64()), pa.array(changed, pa.bool_())], ["row", "doc_id", "items", "share", "changed"])

    return run


def _sieve(shared, share: float, run_words: int, place: int, columns: int):
    """The first ``columns`` columns of the rows whose text, in column ``place``, is clean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, _, _ = _judged(batch.column(place), shared.value, share, run_words)
            yield pa.RecordBatch.from_arrays(batch.columns[:columns], names=batch.schema.names[:columns]).filter(pa.array([not x for x in items], pa.bool_()))

    return run


def _shared(benchmark: DataFrame, block_windows: int) -> list:
    """The benchmark's blocks as broadcast tables."""
    bench = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    # windows are fewer than words, and words fewer than half the bytes
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2
    parts = max(1, -(-size // block_windows))
    out = []
    for part in range(parts):
        items = [tuple(r) for r in bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).distinct().orderBy("item_id", "text").collect()]
        out.append(benchmark.sparkSession.sparkContext.broadcast(_index(items)))
    return out


def _verdicts(rows: DataFrame, shared: list, share: float, run_words: int) -> DataFrame:
    """``(row, doc_id, items, share, changed)`` for each of ``rows(row, doc_id, text)``; with several blocks their numbers must stay the same."""
    found = [rows.mapInArrow(_probe(x, share, run_words), "row long, doc_id long, items array<long>, share double, changed boolean") for x in shared]
    if len(found) == 1:
        return found[0]
    # one verdict per row; blocks hold different items
    return union_all(found).groupBy("row", "doc_id").agg(F.flatten(F.collect_list("items")).alias("items"), F.max("share").alias("share"), F.max("changed").alias("changed"))


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, run_words: int = 13, block_windows: int = 2_000_000) -> DataFrame:
    """``(doc_id, contaminated, n_items, items, share, reparameterised)`` for each row of ``docs``.

    ``items`` are the ids of the benchmark items found (sorted), ``share`` the largest share of one item's
    windows, ``reparameterised`` whether some item was found with other slot values. Null and empty texts
    are clean, very long ones are judged whole. Items with fewer than five template tokens have no window and match
    nothing. Rows that share a doc_id are judged each; with an empty benchmark all are clean, and no rows give no
    rows. Other columns are ignored, whatever their names.
    """
    shared = _shared(benchmark, block_windows)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _verdicts(rows if len(shared) == 1 else materialize(rows, "rows"), shared, share, run_words)
    items = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"), "share", F.col("changed").alias("reparameterised"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, run_words: int = 13, block_windows: int = 2_000_000) -> DataFrame:
    """The rows without those that hold a benchmark item, each by its own text, whatever its id; columns are unchanged."""
    shared = _shared(benchmark, block_windows)
    text = docs["text"].cast("string")
    if len(shared) == 1:
        n = len(docs.columns)
        if docs.schema["text"].dataType == T.StringType():  # a text goes to the workers once
            return docs.mapInArrow(_sieve(shared[0], share, run_words, docs.columns.index("text"), n), docs.schema)
        return docs.select("*", text.alias("_judged")).mapInArrow(_sieve(shared[0], share, run_words, n, n), docs.schema)
    kept = materialize(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"), text.alias("text")), "rows")
    gone = _verdicts(kept.select("row", F.lit(None).cast("long").alias("doc_id"), "text"), shared, share, run_words).where(F.size("items") > 0).select("row")
    return kept.join(gone, "row", "left_anti").select("doc.*")
