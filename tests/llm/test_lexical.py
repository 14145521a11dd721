import collections
import math
import re

import numpy as np
import pytest

from drawlake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score string, item_id int"
ITEMS = "item_id long, text string, doc_id string"


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k):
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, n_all = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for doc_id, c in counts:
            if c:
                m = 10 + (90 * c.total() * n_docs) // n_all
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)))
                scores.append((score, doc_id))
        scores = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item_id, r, d, s) for r, (s, d) in enumerate(scores, 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, k=10, **rest):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS)
    i = spark.createDataFrame([(*r, "x") for r in items], ITEMS)
    return sorted((tuple(r) for r in lexical.search(d, i, k, **rest).collect()), key=repr)


def corpus(n, seed, words=60):
    rng = np.random.default_rng(seed)
    pool = [*(f"w{i}" for i in range(words)), "Straße", "É", "über", "x" * 15, "y" * 16, "z" * 40 + "A", "日本"]
    return [" ".join(rng.choice(pool, rng.integers(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("cells", [lexical.CELLS, 64])
def test_against_brute_force(spark, cells):
    """Ties, repeated documents and long terms; batches of any size give the same."""
    docs = list(enumerate(corpus(300, 1)))
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [docs[3], docs[3]]
    items = list(enumerate(corpus(12, 2)))
    assert run(spark, docs, items, cells=cells) == brute(docs, items, 10)
    assert run(spark, docs, items, k=3, cells=cells) == brute(docs, items, 3)


def test_blocks_of_items(spark):
    docs, items = list(enumerate(corpus(80, 3))), list(enumerate(corpus(20, 4)))
    assert run(spark, docs, items, block_bytes=300) == brute(docs, items, 10)


def test_odd_rows(spark):
    long = " ".join(corpus(2000, 5))
    docs = [(1, None), (2, ""), (3, long), (None, "w1 w2"), (None, "w1 w2"), (5, "W1-w2"), (5, "w1"), (7, ".,; "), (8, "unknown")]
    items = [(0, "w1 w2"), (0, "w1 w2"), (0, "w2 w3"), (1, None), (2, ""), (None, "w1"), (4, "nowhere"), (5, long)]
    assert run(spark, docs, items, k=4) == brute(docs, items, 4)
    assert run(spark, [], items) == [] == run(spark, docs, [])
    assert run(spark, [(1, None), (2, "")], items) == []
