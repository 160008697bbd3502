"""Ranked search against scoring every document for every query."""

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

from test_operators import EDGES, empty, rows, spark, table  # noqa: E402, F401

from crawlatlas.llm import lexical  # noqa: E402

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def ranked(docs, items, k):
    found = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in found:
            m = 50 + 50 * c.total() * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def corpus(seed, docs=600):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    pick = lambda n: " ".join(words[min(299, int(r.paretovariate(0.6)) - 1)] for _ in range(n))
    texts = [pick(int(r.paretovariate(0.8) * 5) % 900) for _ in range(docs)]
    texts += [texts[0]] * 80 + ["hot common words"] * 120
    items = [(i, pick(r.choice([1, 3, 12, 40]))) for i in range(25)] + [(25, "hot"), (26, "common unheard-of"), (27, "none,of;these"), (28, None), (28, "w0 W0 w1")]
    return list(enumerate(texts)), items


@pytest.mark.parametrize(("seed", "k", "first", "bucket"), [(1, 5, 50, 16), (2, 50, 10_000, 4096), (3, 1, 1, 7), (4, 20, 100, 64)])
def test_equals_scoring_all(spark, monkeypatch, seed, k, first, bucket):  # noqa: F811
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    docs, items = corpus(seed)
    got = rows(lexical.search(table(spark, docs), table(spark, items, ITEMS), k, first=first))
    assert got == ranked(docs, items, k)


def test_blocks_of_queries(spark, monkeypatch):  # noqa: F811
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 9)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
    docs, items = corpus(6, 150)
    queries = lexical.terms_of(table(spark, items, ITEMS), "item_id", "text")
    assert len(list(lexical.blocks(queries))) > 3
    assert rows(lexical.search(table(spark, docs), table(spark, items, ITEMS), 10)) == ranked(docs, items, 10)


def test_edges(spark, empty):  # noqa: F811
    docs = [*EDGES, (None, "the cat"), (None, "the cat")]
    items = [(1, "The CAT sat"), (2, "日本語 ünï"), (3, ""), (None, "mit license"), (4, "x" * 30_000)]
    assert rows(lexical.search(table(spark, docs), table(spark, items, ITEMS), 50)) == ranked(docs, items, 50)
    assert rows(lexical.search(empty, table(spark, items, ITEMS), 50)) == []
    assert rows(lexical.search(table(spark, docs), table(spark, [], ITEMS), 50)) == []


def test_long_texts_are_split_in_stretches(monkeypatch):
    text = "Ab c-d  é1 " * 500 + "z" * 300 + " end"
    monkeypatch.setattr(lexical, "STRETCH", 50)
    assert {k.decode(): v for k, v in lexical.counted(text.encode()).items()} == Counter(terms(text))


def test_bounds_leave_out_most_and_no_winner():
    """On vectors of very different lengths less than half is rescored, and none that reaches the threshold is lost."""
    r = np.random.default_rng(5)
    n_terms, sizes = 400, r.integers(1, 60, 3000)
    weights = r.integers(1, 20_000, n_terms)
    terms_ = np.concatenate([np.sort(r.choice(n_terms, s, replace=False)) for s in sizes])
    values = r.integers(1, 900_000, len(terms_))
    at = np.append(0, np.cumsum(sizes))
    length = np.sqrt(np.add.reduceat(values.astype(float) ** 2 * weights[terms_], at[:-1]))
    import pyarrow as pa
    bucket = lexical.Bucket(pa.array(np.arange(3000)), length, at, terms_, values, n_terms)
    dense = np.zeros(n_terms, np.int64)
    rescored = 0
    for i in range(20):
        q = lexical.Query(i, r.choice(n_terms, 12, replace=False), weights, 1)
        everyone = bucket.scores(q, np.arange(3000), dense)
        least = int(np.sort(everyone)[-10])
        left = bucket.survivors(q, least)
        assert set(np.flatnonzero(everyone >= least)) <= set(left.tolist())
        rescored += len(left)
    assert rescored < 20 * 3000 * 0.5
