"""Generations of contextual extraction: held against a plain version, and on hidden identifiers."""

import random
from collections import defaultdict

import pytest

pytest.importorskip("crawlatlas.llm")

from crawlatlas.llm import pii  # noqa: E402


def plain_sure(texts):
    """Sure patterns by dictionaries, each with its kind."""
    n, known = defaultdict(int), {}
    for t in texts:
        for p, v, kind, _, _ in pii.occurrences(t, pii.base_spans(t)):
            n[p, v] += 1
            if kind is not None:
                known[v] = max(kind, known.get(v, -1))
    by_pattern, by_value = defaultdict(dict), defaultdict(list)
    for (p, v), c in n.items():
        by_pattern[p][v] = c
        by_value[v].append(p)
    sure = {}
    while True:
        score = {v: [float(known.get(v) == k) for k in range(4)] for v in by_value}
        for turn in range(pii.TURNS):
            seeds = {p: sum(v in known for v in vs) for p, vs in by_pattern.items()}
            share = {p: [sum(c * score[v][k] for v, c in vs.items()) / sum(vs.values()) for k in range(4)]
                     for p, vs in by_pattern.items() if seeds[p]}
            if turn + 1 < pii.TURNS:
                for v, ps in by_value.items():
                    if v not in known:
                        score[v] = [max((share[p][k] * seeds[p] / (seeds[p] + 1) for p in ps if p in share), default=0.0)
                                    for k in range(4)]
        for p, s in share.items():
            if seeds[p] >= pii.MIN_SEEDS and max(s) >= pii.MIN_SHARE:
                sure.setdefault(p, (max(s), s.index(max(s))))
        added = {v: max(sure[p] for p in ps if p in sure)[1]
                 for v, ps in by_value.items() if v not in known and any(p in sure for p in ps)}
        if not added:
            return sure
        known |= added


def plain_spans(texts):
    sure, out = plain_sure(texts), []
    for t in texts:
        best = {}
        for p, _, kind, a, b in pii.occurrences(t, pii.base_spans(t)):
            if kind is None and p in sure:
                best[a, b] = max(best.get((a, b), (0, 0)), sure[p])
        out.append(sorted(pii.base_spans(t) + [(k, a, b) for (a, b), (_, k) in best.items()]))
    return out


def corpus(rnd):
    """Texts with phone numbers, and the spans of those that no base pattern knows.

    "hotline:" stands before known numbers and hidden ones of the first generation, "reach ... tonight"
    before these and hidden ones of the second. "order" and "lot" stand before numbers that are none.
    """
    words = "river stone maple quiet garden seven blue paper window early north simple bread".split()
    texts, hidden = [], []

    def prose():
        return " ".join(rnd.choices(words, k=rnd.randint(3, 12)))

    def add(before, number, after, secret):
        head = f"{prose()} {before}"
        texts.append(f"{head}{number}{after} {prose()}")
        hidden.append([(3, len(head), len(head) + len(number))] if secret else [])

    first = [f"0{rnd.randint(10, 99)} {rnd.randint(1000000, 9999999)}" for _ in range(40)]
    second = [f"0{rnd.randint(10, 99)}-{rnd.randint(1000000, 9999999)}" for _ in range(15)]
    for _ in range(160):
        add("hotline: ", f"+{rnd.randint(10, 99)} {rnd.randint(10000000, 99999999)}", ",", False)
    for number in first:
        add("hotline: ", number, ",", True)
        add("reach ", number, " tonight", True)
    for number in second:
        add("reach ", number, " tonight", True)
    for _ in range(120):
        add(rnd.choice(["order ", "lot "]), str(rnd.randint(10**7, 10**11)), " shipped", False)
    texts += [prose() for _ in range(100)]
    hidden += [[] for _ in range(100)]
    return texts, hidden


def spans_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(docs).collect()}
    return [sorted(got[i]) for i in range(len(texts))]


def test_two_generations_find_hidden_numbers(spark):
    texts, hidden = corpus(random.Random(3))
    got = spans_of(spark, texts)
    assert got == plain_spans(texts)
    more = [set(g) - set(pii.base_spans(t)) for g, t in zip(got, texts)]
    right = sum(len(m & set(h)) for m, h in zip(more, hidden))
    assert right >= 0.9 * sum(map(len, hidden)) and right >= 0.9 * sum(map(len, more))
    # The second generation alone holds these.
    tail = [m for m, h, t in zip(more, hidden, texts) if h and "reach" in t]
    assert sum(map(bool, tail)) >= 0.9 * len(tail)


def test_patterns_hold_signs_both_sides_and_line_starts():
    t = "Call us (tel): 0123456789 today\n  0123456780 Fax"
    got = {(p, a) for p, _, _, a, _ in pii.occurrences(t, [])}
    at, line = t.index("0123456789"), t.index("0123456780")
    assert {("n<tel", at), ("n<us tel", at), ("n<tel):", at), ("n<tel>today", at), ("n^>fax", line)} <= got
    assert ("n^>today", at) not in got
    mail = "write to jo (at) site (dot) org now"
    assert {p[0] for p, *_ in pii.occurrences(mail, [])} == {"a"}


def test_numbers_in_mixed_contexts_stay(spark):
    texts = [f"room {n} {'+4712345' + str(100 + n) if n % 2 else 1234567000 + n} floor" for n in range(40)]
    got = spans_of(spark, texts)
    assert got == plain_spans(texts)
    assert got == [sorted(pii.base_spans(t)) for t in texts]
