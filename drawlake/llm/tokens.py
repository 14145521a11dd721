"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens on whole blocks of code points at once. Which characters are letters, numbers, marks or
white space is asked of the tokenizer's own pre-tokenizer, so its tables and ours can't differ. The distinct
pre-tokens of a block are one ragged numpy array of symbols; in every round each of them applies its lowest-rank pair,
at all its places from left to right, until no pair of any has a rank. The surviving symbols are the tokens.

A pre-token of more than ``LONG`` symbols would need very many rounds. All such of a block merge together, rank by
rank, with the places of each pair kept by rank, so that a round costs what it merges; results are the same, as
no pair has a lower rank than the merges that made its parts (checked when the file is read).

Scale. Documents are counted where they are read, without a shuffle. A task holds one block of texts, the tables of
the vocabulary and the counts of the last ``1 << SLOT_BITS`` distinct short pre-tokens (compared byte by byte).
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.llm.bytesops import U64, blocks, code_points, column_bytes, mix, packed, ragged

LETTER, NUMBER, OTHER, SPACE, APART = range(5)
#: Symbols from which a pre-token is merged rank by rank.
LONG = 512
SLOT_BITS = 20
NONE = np.int64(1) << 40  # the rank of a pair that doesn't merge
#: What the byte-level pattern splits off behind an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE file of the tokenizers library; one that asks for anything else is an error."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if odd or model.get("type", "BPE") != "BPE" or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: added tokens with rules of their own are not supported")
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        contents = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(c.encode()) for c in contents)) if contents else None
        vocab = model["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs)))
        rank_of = np.full(max(vocab.values()) + 1, -1, np.int64)
        rank_of[made] = np.arange(len(made))
        if (np.maximum(rank_of[left], rank_of[right]) >= np.arange(len(made))).any():
            raise ValueError(f"{path}: a merge comes before those that make its parts")
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order, made
        self.kinds = np.full(0x110000, 255, np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` for pairs that don't merge."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank[at], NONE)

    def kind(self, chars: np.ndarray) -> np.ndarray:
        """Letter, number, other or space, as the pre-tokenizer has it; asked once for each 256 code points that occur."""
        for page in np.flatnonzero(np.bincount(chars >> 8)):
            if self.kinds[page << 8] == 255:
                codes = np.array([c for c in range(page << 8, (page + 1) << 8) if not 0xD800 <= c < 0xE000])
                found = np.full(len(codes), SPACE, np.uint8)
                for kind, probe in ((OTHER, "!"), (NUMBER, "1"), (LETTER, "a")):
                    starts = np.zeros(2 * len(codes), bool)
                    starts[[s for _, (s, _) in self.splitter.pre_tokenize_str("".join(probe + chr(c) for c in codes))]] = True
                    found[~starts[1::2]] = kind  # it goes on with the probe
                self.kinds[page << 8 : (page + 1) << 8] = SPACE
                self.kinds[codes] = found
        return self.kinds[chars]

    def pretokens(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a block (texts, a space after each): first byte and size of each pre-token, the pre-token that each text starts with, and special tokens by text."""
        chars, edges = code_points(data, starts)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        kind = self.kind(chars)
        kind[edges[1:] - 1] = APART
        special = np.zeros(len(starts) - 1, np.int64)
        for m in self.special.finditer(data.tobytes()) if self.special else ():
            a, b = np.searchsorted(at, m.span())
            if not (kind[a:b] == APART).any():
                kind[a:b] = APART
                special[np.searchsorted(starts, m.start(), "right") - 1] += 1
        before = np.append(np.uint8(APART), kind[:-1])
        behind = np.append(kind[1:], np.uint8(APART))
        blank = (chars == 0x20) & (kind == SPACE)
        first = kind != before
        # the last of several spaces goes apart, a blank with the word behind it
        first |= (kind == SPACE) & (behind != SPACE) & (behind != APART)
        first[1:] &= ~(blank[:-1] & (kind[1:] != SPACE) & (kind[1:] != APART))
        first |= kind == APART
        quote = np.flatnonzero(first & (chars == 0x27) & (kind == OTHER))
        for ending in ENDINGS:
            here = quote[quote + len(ending) < len(chars)]
            for n, c in enumerate(ending, 1):
                here = here[(chars[here + n] == ord(c)) & (kind[here + n] != APART)]
            first[here + 1] = False
            first[here + len(ending) + 1] = True  # a separator ends each block
        begin = np.flatnonzero(first)
        size = np.diff(at[np.append(begin, len(chars))])
        real = kind[begin] != APART
        return at[begin[real]], size[real], np.searchsorted(begin[real], edges), special

    def surviving(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence (none is empty) when nothing merges any more."""
        counts = sizes.copy()
        long = sizes > LONG
        if long.any():
            own = np.repeat(long, sizes)
            counts[long] = self._by_rank(symbols[own], sizes[long])
            symbols, sizes = symbols[~own], sizes[~long]
        index = np.flatnonzero(~long)
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        rank = np.append(self.ranks(symbols[:-1], symbols[1:]), NONE) if len(symbols) else np.zeros(0, np.int64)
        rank[last] = NONE
        while len(symbols):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, starts)
            going = low < NONE
            counts[index[~going]] = sizes[~going]
            kept = np.repeat(going, sizes)
            symbols, rank, last = symbols[kept], rank[kept], last[kept]
            index, sizes, low = index[going], sizes[going], low[going]
            if not len(symbols):
                break
            place = np.repeat(np.arange(len(sizes)), sizes)
            hit = np.flatnonzero(rank == low[place])
            hit = hit[_first_of_pairs(hit[1:] == hit[:-1] + 1)]
            symbols[hit], last[hit] = self.made[rank[hit]], last[hit + 1]
            stays = np.ones(len(symbols), bool)
            stays[hit + 1] = False
            sizes = sizes - np.bincount(place[hit], minlength=len(sizes))
            symbols, rank, last = symbols[stays], rank[stays], last[stays]
            new = hit - np.arange(len(hit))
            changed = np.zeros(len(symbols), bool)
            changed[new] = True
            changed[new[new > 0] - 1] = True
            rank[changed & last] = NONE
            new = np.flatnonzero(changed & ~last)
            rank[new] = self.ranks(symbols[new], symbols[new + 1])
        return counts

    def _by_rank(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``surviving`` of long sequences: all places of a pair at once, lowest ranks first."""
        n = len(symbols)
        behind, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        behind[ends - 1] = -1
        before[ends - sizes] = -1
        alive, symbols = np.ones(n, bool), symbols.copy()
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(places: np.ndarray) -> None:
            places = places[(places >= 0) & (behind[places] >= 0)]
            rank = self.ranks(symbols[places], symbols[behind[places]])
            order = np.argsort(rank, kind="stable")[: np.count_nonzero(rank < NONE)]
            places, rank = places[order], rank[order]
            for part in np.split(np.arange(len(rank)), np.flatnonzero(np.diff(rank)) + 1) if len(rank) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(places[part])

        add(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            hit = np.unique(np.concatenate(waiting.pop(r)))
            hit = hit[alive[hit] & (behind[hit] >= 0)]
            hit = hit[self.ranks(symbols[hit], symbols[behind[hit]]) == r]
            if not len(hit):
                continue
            hit = hit[_first_of_pairs(hit[1:] == behind[hit[:-1]])]
            gone = behind[hit]
            symbols[hit], alive[gone] = self.made[r], False
            behind[hit] = behind[gone]
            follow = behind[hit]
            before[follow[follow >= 0]] = hit[follow >= 0]
            add(np.unique(np.append(hit, before[hit])))
        return np.add.reduceat(alive.astype(np.int64), ends - sizes)


def _first_of_pairs(touches: np.ndarray) -> np.ndarray:
    """Of places in order, where ``touches`` says that one overlaps the one before: those that merge, from left to right."""
    n = len(touches) + 1
    at = np.arange(n)
    run = np.maximum.accumulate(np.where(np.append(False, touches), 0, at))
    return (at - run) % 2 == 0


class Counter:
    """Token counts of blocks; remembers short pre-tokens."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.low, self.high = np.zeros(1 << SLOT_BITS, U64), np.zeros(1 << SLOT_BITS, U64)
        self.known = np.zeros(1 << SLOT_BITS, np.int64)

    def _merged(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.vocabulary.surviving(self.vocabulary.of_byte[data[ragged(begin, size)]], size)

    def _lengths(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.zeros(len(begin), np.int64)
        low, high, short = packed(data, begin, size)
        slot = (mix(low ^ mix(high)) >> U64(64 - SLOT_BITS)).astype(np.int64)
        held = short & (self.low[slot] == low) & (self.high[slot] == high)
        out[held] = self.known[slot[held]]
        new = np.flatnonzero(short & ~held)
        new = new[np.lexsort((low[new], high[new]))]
        if len(new):
            differs = np.append(True, (low[new][1:] != low[new][:-1]) | (high[new][1:] != high[new][:-1]))
            one = new[differs]
            counts = self._merged(data, begin[one], size[one])
            out[new] = counts[np.cumsum(differs) - 1]
            self.low[slot[one]], self.high[slot[one]], self.known[slot[one]] = low[one], high[one], counts
        rest: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(~short):
            rest.setdefault(data[begin[i] : begin[i] + size[i]].tobytes(), []).append(i)
        if rest:
            one = np.array([x[0] for x in rest.values()])
            for places, count in zip(rest.values(), self._merged(data, begin[one], size[one])):
                out[places] = count
        return out

    def __call__(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a string column; null has none."""
        out = np.zeros(len(column), np.int64)
        for a, b, data, starts in blocks(column):
            begin, size, first, special = self.vocabulary.pretokens(data, starts)
            upto = np.append(0, np.cumsum(self._lengths(data, begin, size)))
            out[a:b] = upto[first[1:]] - upto[first[:-1]] + special
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a vocabulary file; one for each worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            text = batch.column(1)
            sizes = np.diff(column_bytes(text)[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(count(text))], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each row of ``docs(doc_id, text, ...)``, with the vocabulary file ``path``.

    Tokens are those of the tokenizers library without begin, end or other added tokens; the strings of special tokens
    inside a text count as one each, as by its default. Null and empty texts have none, very long texts are counted
    whole. Repeated rows and ids, null ids included, are counted each; no rows give no rows. Other columns are
    ignored, whatever their names.
    """
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    counted = read.mapInArrow(_count(path), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
