import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from drawlake.llm import trie

TURNS = "conv_id long, turn long, role string, text string, depth string, a int"


def brute(turns):
    own = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    said = {c: [t[-1] for t in sorted(rows)] for c, rows in own.items()}
    whole = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = (*said.get(base, [])[:h], *said[c][h:])
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids, leaves, saved = collections.Counter(p[:-1] for p in members if p), collections.Counter(), collections.Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    ends = {p: hashlib.sha256(",".join(str(c) for c in who if whole[c] == p).encode()).hexdigest() for p, who in members.items()}
    return sorted((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p], ends[p]) for p, who in members.items()) if members else []


def run(spark, turns, **rest):
    got = trie.prefix_trie(spark.createDataFrame([(*t, "x", 1) for t in turns], TURNS), **rest)
    assert got.columns == trie.OUT
    return sorted(tuple(r) for r in got.collect())


def dialogues(n, seed, longest):
    """Branching dialogues, many with common openings, some equal, some very long."""
    rng = np.random.default_rng(seed)
    turns, lines = [], []
    for c in range(n):
        line = list(lines[rng.integers(len(lines))][: rng.integers(0, longest)]) if lines and rng.random() < 0.8 else []
        line += [("user" if rng.random() < 0.6 else "assistant", " ".join(rng.choice(["one", "two", "three"], rng.integers(0, 3)))) for _ in range(int(rng.integers(0, 4)))]
        if c % 37 == 5:
            line += [("user", f"go on {i % 3}") for i in range(longest)]
        lines.append(line)
        turns += [(c * 7 % n, i, *t) for i, t in enumerate(line)]
    return turns


@pytest.mark.parametrize("width, cells, batch", [(64, 1 << 18, 10_000), (64, 40, 10_000), (3, 25, 10_000), (3, 1 << 18, 4)])
def test_against_brute_force(spark, width, cells, batch):
    """Blocks, shards and batches of any size give the same nodes."""
    turns = dialogues(140, 3, 14)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        assert run(spark, turns, width=width, shard_cells=cells) == brute(turns)
    finally:
        spark.conf.set(key, before)


def test_copies_and_one_long_conversation(spark):
    """A third of the conversations are equal, and one holds most turns."""
    turns = [(c, i, "user", f"line {i}") for c in range(60) for i in range(3 if c % 3 else 6)] + [(90, i, "user", f"line {i}") for i in range(700)]
    assert run(spark, turns, width=16, shard_cells=60) == brute(turns)


def test_exact_block_ends(spark):
    """Conversations that end where a block ends, with and without others that go on."""
    turns = [(c, i, "u", f"t{i if c % 40 < 20 else i + 1}") for c in (0, 20, 21, 1, 2, 3) for i in range({0: 4, 20: 4, 21: 8, 1: 4, 2: 9, 3: 8}[c])]
    assert run(spark, turns, width=4) == brute(turns)


def test_odd_rows(spark):
    long = "word " * 50_000
    turns = [(0, None, None, None), (0, 1, "user", long), (0, 1, "user", "tie"), (0, 1, "user", "tie"), (0, 5, "", ""), (None, 0, "user", "nobody's"), (3, -7, "user", "first"), (3, 2, None, "x"), (-5, 1, "a", "b"), (-25, 1, "a", "b"), (7, None, "user", long), (45, 0, "u", "only"), (46, 0, "u", "only"), (47, 0, "u", "only"), (48, 0, "u", "only")]
    assert run(spark, turns) == brute(turns)
    assert run(spark, []) == [] == run(spark, [(None, 1, "a", "b")])
    assert run(spark, [(1, 0, "a", "b")]) == brute([(1, 0, "a", "b")])
