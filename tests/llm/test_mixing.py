"""Mixing against a plain version: shares by repeated dealing, draws as near to the targets as promised."""

import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

from test_operators import EDGES, rows, spark, table  # noqa: E402, F401

from crawlatlas.llm import mixing  # noqa: E402

SCHEMA = "doc_id long, text string, source string"


def dealt(sizes, cycle=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing out again and again what is above the most that a source may give."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        given = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if given[s] > most * sizes[s]}
        if not over:
            return {s: given.get(s, most * sizes[s]) for s in names}
        full |= over


def corpus(seed, sources=7, docs=2000):
    r = random.Random(seed)
    names = [None, *(r.choice(["é", "Z", "a", "\U0001f600", "￿"]) + str(i) for i in range(sources - 1))]
    out = []
    for i in range(docs):
        source = names[0] if r.random() < 0.3 else names[min(sources - 1, int(r.expovariate(0.7)))]
        out.append((i, " \t".join(["w"] * int(r.paretovariate(1.2))) if r.random() < 0.95 else r.choice([None, "", "  "]), source))
    return out


@pytest.mark.parametrize(("seed", "cycle", "share", "most"), [(1, (3, 1, 2), 1.5, 2.0), (2, (3, 1, 2), 1.5, 2.0), (3, (1, 50), 1.2, 2.0),
                                                              (4, (3, 1, 2), 0.4, 1.0), (5, (2, 7, 1), 2.0, 2.0)])
def test_targets_and_copies(spark, seed, cycle, share, most):  # noqa: F811
    docs = corpus(seed)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    sizes = defaultdict(int)
    for d, _, s in docs:
        sizes[s] += size[d]
    want = dealt(sizes, cycle, share, most)
    measured = mixing.measured(table(spark, docs, SCHEMA))
    shares = mixing.targets(measured, cycle, share, most)
    assert {r["source"]: pytest.approx(r["target"]) for r in shares.collect()} == want
    got = mixing.drawn(measured, mixing.planned(measured, shares)).select("doc.doc_id", "source", "size", "source_size", "copies", "taken").collect()
    taken = Counter()
    for r in got:
        rate = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[r["source"]] and r["taken"] == r["copies"] * r["size"]
        assert int(rate + 1e-9) <= r["copies"] <= -int(-rate // 1) + (rate != int(rate)) and r["copies"] <= most
        taken[r["source"]] += r["taken"]
    assert len(got) == len(docs)
    largest = max(size.values())
    assert all(abs(taken[s] - want[s]) <= max(largest, 0.02 * want[s]) for s in want)
    again = mixing.drawn(measured.repartition(5), mixing.planned(measured.repartition(7), mixing.targets(measured, cycle, share, most)))
    assert rows(again, "doc.doc_id", "copies") == sorted(((r["doc_id"], r["copies"]) for r in got), key=repr)


def test_documents_go_out_as_often_as_taken(spark):  # noqa: F811
    docs = table(spark, [(d, t, f"s{i % 3}") for i, (d, t) in enumerate(EDGES)], SCHEMA)
    measured = mixing.measured(docs)
    plan = mixing.planned(measured, mixing.targets(measured))
    copies = Counter()
    for r in mixing.drawn(measured, plan).select("doc.doc_id", "doc.text", "copies").collect():
        copies[r["doc_id"], r["text"]] += r["copies"]
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy"]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == +copies


def test_one_hot_source(spark):  # noqa: F811
    """A source with nearly all words takes twice its share of nothing more than it has."""
    docs = [(i, "w " * 50, "hot") for i in range(900)] + [(1000 + i, "w " * 50, f"s{i}") for i in range(4)]
    measured = mixing.measured(table(spark, docs, SCHEMA))
    got = mixing.drawn(measured, mixing.planned(measured, mixing.targets(measured)))
    taken = {r["source"]: r["n"] for r in got.groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    want = dealt(Counter({"hot": 45_000, **{f"s{i}": 50 for i in range(4)}}))
    assert all(abs(taken[s] - want[s]) <= 50 + 0.002 * want[s] for s in want)


def test_nothing_to_mix(spark):  # noqa: F811
    assert rows(mixing.mix(table(spark, [], SCHEMA))) == []
    blank = mixing.measured(table(spark, [(1, None, "a"), (2, "", None)], SCHEMA))
    got = mixing.drawn(blank, mixing.planned(blank, mixing.targets(blank)))
    assert rows(got, "doc.doc_id", "size", "source_size", "target", "taken") == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
