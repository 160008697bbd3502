"""Every operator against brute force on small tables with nulls, ties, repeated rows and long texts."""

import random
import sys
from fractions import Fraction
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

import brute  # noqa: E402

from crawlatlas.llm import bpe, jaccard, langid, licenses, packing, pii, spotsigs, topk, trainorder, warc  # noqa: E402
from crawlatlas.llm.common import scratch  # noqa: E402
from crawlatlas.llm.components import components  # noqa: E402
from crawlatlas.llm.tokens import Encoder  # noqa: E402
from crawlatlas.session import build_session  # noqa: E402

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
# Names that the operators use inside.
CLASHING = ["key", "doc", "rep", "slice", "place", "row", "component", "digest", "text_hash", "t1", "_row", "found", "length"]

EDGES = [
    (1, "The cat sat on the mat. The dog did not, as it was out."), (2, None), (3, ""), (4, "  \t\n "), (5, "word"),
    (6, "two words"), (7, "The cat sat on the mat. The dog did not, as it was out."), (7, "a second text of the same id"),
    (9, "x" * 30_000), (10, "é Ünï 日本語 Σίσυφος ΣΑΣ 123 don't WE'LL   end"), (11, "12 34! ?? 5.6"),
    (12, "<|endoftext|> and <|startoftext|> in text"), (13, "ab " * 9_000),
    (14, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
         "Lesser General Public License. Released under the MIT License. MIT licenses, the mit  License"),
    (15, "mail a.b+c@mail.example.com or +1 (743) 555-3824, 10.0.0.255 but not 10.0.0.256 4111 1111 1111 1111"),
    (12, "<|endoftext|> and <|startoftext|> in text"),
]


@pytest.fixture(scope="module")
def spark():
    session = build_session("local[4]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    return session


def table(spark, rows, schema="doc_id long, text string", clash=True):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.select("*", *[F.lit("other").alias(c) for c in CLASHING if c not in df.columns]) if clash else df


@pytest.fixture(scope="module")
def edges(spark):
    return table(spark, EDGES)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# --- n-gram Jaccard join

def near_copies(seed, families=12, members=9):
    """Texts that differ from a family's text by edits, and texts that share most of a template."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    out = []
    for _ in range(families):
        base = [word() for _ in range(r.choice([3, 8, 15, 40, 90, 250]))]
        for _ in range(members):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                at = r.randrange(len(text))
                text[at:at + r.choice([0, 1, 1])] = [word()]
            out.append(" ".join(text))
    r.shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize(("n", "percent", "hot", "seed"), [(3, 90, 48, 1), (3, 90, 2, 2), (5, 80, 2, 3), (5, 80, 48, 4), (2, 60, 3, 5)])
def test_jaccard_equals_all_pairs(spark, n, percent, hot, seed):
    docs = near_copies(seed)
    got = jaccard.near_duplicates(table(spark, docs), n, Fraction(percent, 100), hot=hot)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.groups(docs, n, percent), key=repr)


def test_jaccard_edges(spark, edges, empty):
    got = rows(jaccard.near_duplicates(edges, 3, Fraction(9, 10)))
    assert len(got) == len(EDGES)
    of = {(d, n): c for d, n, c in got}
    assert of[1, 12] == of[7, 12] == of[7, 5] == 1  # rows of one id are one document
    assert of[2, 0] == 2 and of[3, 0] == 3 and of[4, 0] == 4 and of[5, 1] == 5 and of[6, 1] == 6
    assert rows(jaccard.near_duplicates(empty, 3, Fraction(9, 10))) == []
    nulls = table(spark, [(None, "a b c d"), (None, None), (4, "a b c d")])
    assert rows(jaccard.near_duplicates(nulls, 3, Fraction(9, 10))) == [(4, 2, 4), (None, 0, None), (None, 2, None)]


def test_allocation_follows_the_sizes():
    few = jaccard.allocate({12: (10, 10 * 150)}, Fraction(8, 10)).bands[12]
    many = jaccard.allocate({12: (10**9, 10**9 * 150)}, Fraction(8, 10)).bands[12]
    assert few.segments == many.segments == jaccard.most_different(12, Fraction(8, 10)) + 1
    assert few.near < many.near
    for size in range(1, 3000):
        band = jaccard.band_of(size)
        assert jaccard.first_of(band) <= size < jaccard.first_of(band + 1)


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(50 - i, 51 - i) for i in range(40)],
    [(random.Random(7).randrange(80), random.Random(i).randrange(80)) for i in range(70)], []])
def test_components(spark, links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert rows(got, "node", "component") == sorted(((x, root(x)) for x in parent), key=repr)


# --- WARC

PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "http://d/\r\nX: y", ""),
         (5, "http://e/", "<p>été\r\n\r\n</p>"), (5, "http://e/", "<p>été\r\n\r\n</p>"), (None, "http://f/", "<p>one</p>")]


def test_warc(spark):
    import base64
    import hashlib

    path = scratch(spark, "warc")
    warc.write(table(spark, PAGES, "page_id long, url string, html string"), path)
    got = warc.read(spark, path).select("*", *[warc.field(n).alias(n) for n in (
        "WARC-Type", "X-Page-Id", "X-Refers-To-Page-Id", "WARC-Payload-Digest", "Content-Length")]).collect()
    assert sorted(((r["X-Page-Id"], r["WARC-Type"], r["X-Refers-To-Page-Id"], bytes(r["payload"]).decode()) for r in got), key=repr) == sorted([
        ("1", "revisit", "2", "<p>one</p>"), ("2", "response", None, "<p>one</p>"), (None, "revisit", "2", "<p>one</p>"),
        ("3", "revisit", "4", ""), ("4", "response", None, ""), ("5", "response", None, "<p>été\r\n\r\n</p>"),
        ("5", "revisit", "5", "<p>été\r\n\r\n</p>")], key=repr)
    for r in got:
        payload, record = bytes(r["payload"]), bytes(r["record"])
        head, _, block = record.partition(b"\r\n\r\n")
        assert record.startswith(bytes(r["header"])) and record.endswith(b"\r\n\r\n")
        assert int(r["Content-Length"]) == len(block) - 4
        assert block[:-4].endswith(payload) if r["WARC-Type"] == "response" else payload == b"" or payload not in block
        assert r["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert head.count(b"\nX: y") == 0
    assert spark.read.parquet(f"{path}/payloads").count() == 3


def test_warc_small_payloads_and_damage(spark):
    path = scratch(spark, "warc")
    warc.write(table(spark, PAGES, "page_id long, url string, html string"), path, min_bytes=1)
    kinds = warc.read(spark, path).where(F.octet_length("payload") == 0).select(warc.field("WARC-Type")).collect()
    assert [r[0] for r in kinds] == ["response", "response"]
    damaged = scratch(spark, "warc")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{damaged}/headers")
    (spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
     .write.parquet(f"{damaged}/payloads"))
    with pytest.raises(Exception, match="missing or changed"):
        warc.read(spark, damaged).collect()
    nothing = scratch(spark, "warc")
    warc.write(table(spark, [], "page_id long, url string, html string"), nothing)
    assert warc.read(spark, nothing).collect() == []


# --- personal data

HARD = ["a@b@c.com x@y.z..w", "1.2.3.4.5.6.7.8.9", "1.2.3.4.300.1.1.1", "0255.1.1.1 1.1.1", "4111-1111 1111-1111 4111111111111112",
        "+1 (743) 555-3824 +12 +1((( +123456789012345678", "..a..@x.y-z.a_b", "4111  1111 1111 1111", "+1234567890+1234567890",
        "@a.b a@.b a@b. é@é.fr", "1" * 5000, "a" * 5000 + "@", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9", "+" * 3000, "+1" * 3000]


def shown(spans):
    return [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans]


def test_pii_base_spans_equal_the_patterns():
    r = random.Random(3)
    texts = HARD + ["".join(r.choice("ab1234.@+- ()é") for _ in range(60)) for _ in range(3000)]
    for t in texts:
        assert shown(pii.base_spans(t)) == brute.pii(t), t


def contextual():
    r = random.Random(5)
    digits = lambda n: "".join(r.choice("123456789") for _ in range(n))
    seeds = [(i, f"please ring us on +1 ({digits(3)}) {digits(3)}-{digits(4)} today") for i in range(8)]
    return [*seeds, (20, "please ring us on 0171 555 0199 today"), (21, "the number 0171 555 0199 is not one"),
            (22, "order 1234567 came"), (23, None), (24, "")]


def test_pii_finds_unseen_identifiers(spark):
    docs = contextual()
    got = {r["doc_id"]: r for r in pii.find(table(spark, docs)).select(
        "doc_id", pii.shown("base").alias("base"), pii.shown("spans").alias("spans")).collect()}
    for d, t in docs:
        assert got[d]["base"] == ",".join(brute.pii(t))
    assert got[20]["base"] == "" and got[20]["spans"] == "phone:18:31"
    assert all(got[d]["spans"] == got[d]["base"] for d in got if d != 20)
    masked = {r["doc_id"]: r["text"] for r in pii.redact(table(spark, docs)).collect()}
    assert masked[20] == "please ring us on <PHONE> today" and masked[0] == "please ring us on <PHONE> today"
    assert masked[22] == "order 1234567 came" and masked[23] is None and masked[24] == ""
    assert set(pii.redact(table(spark, docs)).columns) == set(table(spark, docs).columns)


def test_pii_edges(edges, empty):
    got = pii.find(edges).select("doc_id", pii.shown("base").alias("base"))
    assert rows(got) == sorted(((d, ",".join(brute.pii(t))) for d, t in EDGES), key=repr)
    assert rows(pii.find(empty)) == [] and rows(pii.redact(empty)) == []


def test_masking_of_overlaps():
    assert pii.masked("abcdef", [(0, 1, 3), (1, 2, 5)]) == "a<EMAIL>f"


# --- language identification

def test_automaton_has_all_substrings_only():
    r = random.Random(1)
    text = [r.randrange(1, 4) for _ in range(60)]
    t = langid.suffix_automaton(np.array(text), 5)
    within = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, min(61, i + 6))}
    for _ in range(2000):
        word, state = tuple(r.randrange(1, 4) for _ in range(r.randint(1, 5))), 0
        for c in word:
            state = t[state, c] if state >= 0 else -1
        assert (state >= 0) == (word in within)


def test_phrases_are_longest_matches():
    r = random.Random(2)
    samples = {"x": ["".join(r.choice("abc ") for _ in range(200))], "y": ["".join(r.choice("bcd ") for _ in range(200))]}
    model = langid.learn(samples, 150)
    own = {}
    for language in samples:
        codes = model.codes(samples[language][0])[:150]
        own[language] = "".join(map(chr, codes[codes != langid.SYMBOLS - 1] + 65))
    texts = ["".join(r.choice("abcdz ") for _ in range(n)) for n in (0, 1, 5, 255, 256, 257, 900)]
    got = model.phrases([model.codes(t) for t in texts])
    for k, language in enumerate(model.languages):
        for j, t in enumerate(texts):
            letters, n = "".join(map(chr, model.codes(t) + 65)), 0
            for at in range(0, len(letters), langid.WINDOW):
                window = letters[at:at + langid.WINDOW]
                while window:
                    n += 1
                    size = 1
                    while size < len(window) and window[:size + 1] in own[language]:
                        size += 1
                    window = window[size:]
            assert got[k, j] == n, (language, t)


def scripts():
    """Texts of four languages of Latin letters, two that share 900 letters of one script, and one of 900 others."""
    r, texts = random.Random(5), {}
    for language, start, letters, size in (("a", 97, 20, 6), ("b", 99, 20, 6), ("c", 101, 20, 6), ("d", 103, 20, 6),
                                           ("ja", 0x4e00, 900, 2), ("ko", 0xac00, 900, 3), ("zh", 0x4e00, 900, 2)):
        words = ["".join(chr(start + r.randrange(letters)) for _ in range(size)) for _ in range(500)]
        join = " " if start < 128 or language == "ko" else ""
        texts[language] = [join.join(r.choices(words, k=150)) for _ in range(30)]
    return texts


def test_letters_of_all_scripts_are_symbols():
    texts = scripts()
    model = langid.learn({language: t[:20] for language, t in texts.items()}, 6000)
    for language, own in texts.items():
        assert [got for got, _ in model.predict([t[:60] for t in own[20:]])] == [language] * 10
    samples = {language: "".join(map(chr, np.concatenate([model.codes(t) for t in texts[language][:20]])[:6000])) for language in texts}
    mixed = [(texts["zh"][20 + i][:40] + texts["ko"][20 + i][:40] + texts["a"][20 + i][:40] + "Щ")[:langid.WINDOW] for i in range(10)]
    got = model.phrases([model.codes(t) for t in mixed])
    for k, language in enumerate(model.languages):
        for j, t in enumerate(mixed):
            left, n = "".join(map(chr, model.codes(t))), 0
            while left:
                n, size = n + 1, 1
                while size < len(left) and left[:size + 1] in samples[language]:
                    size += 1
                left = left[size:]
            assert got[k, j] == n


LANGS = {"en": "the cat and the dog were in the house with other animals ", "de": "der hund und die katze waren mit anderen im haus "}


def test_language_identification(spark, empty):
    docs = [(i, text * 4, lang) for i, (lang, text) in enumerate(list(LANGS.items()) * 20)]
    docs += [(100, None, "en"), (101, "", "en"), (102, "12 !?", "de"), (103, "the house with the dog", None),
             (None, "die katze im haus", "de"), (103, "the house with the dog", None), (104, "日本語", None)]
    df = table(spark, docs, "doc_id long, text string, lang string")
    samples, chars = langid.sample(df, sample_chars=2000)
    assert set(samples) == {"en", "de"} and all(sum(map(len, s)) >= 200 for s in samples.values())
    got = langid.predict(df, langid.learn(samples, chars)).collect()
    assert len(got) == len(docs)
    of = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert all(of[i][0] == lang for i, _, lang in docs[:40])
    assert of[100] == of[101] == of[102] == ("und", 0.0) and of[103][0] == "en" and of[None][0] == "de"
    assert of[104][0] in ("de", "en") and all(0 <= s <= 1 for _, s in of.values())
    nothing = table(spark, [], "doc_id long, text string, lang string")
    model = langid.learn(*langid.sample(nothing))
    assert rows(langid.predict(nothing, model)) == []
    assert {r["lang_pred"] for r in langid.predict(df, model).collect()} == {"und"}


def test_held_out_rows_are_not_learnt(spark):
    import zlib

    docs = [(i, LANGS["en"] * 3 + f" number{i}", "en") for i in range(60)]
    df = table(spark, docs, "doc_id long, text string, lang string")
    out = {d for d, _, _ in docs if zlib.crc32(str(d).encode()) % 5 == 0}
    assert {r["doc_id"] for r in df.where(langid.held_out()).collect()} == out
    learnt = " ".join(langid.sample(df)[0]["en"])
    assert not any(f"number{d} " in learnt + " " for d in out)


# --- fingerprints

@pytest.mark.parametrize("docs", [EDGES, EDGES[:1], [(None, "the cat sat there"), (None, "the dog sat here"), (3, None)]])
def test_fingerprints_of_next(spark, docs):
    got = spotsigs.compare_with_next(table(spark, docs)).collect()
    assert len(got) == len(docs)
    distinct = {}
    for r in got:
        distinct.setdefault(r["doc_id"], []).append(r)
    if len({d for d, _ in docs}) == len(docs):
        ordered = sorted(docs, key=lambda x: -x[0])
        for i, (d, t) in enumerate(ordered):
            after = ordered[(i + 1) % len(ordered)][1] or ""
            new, r = spotsigs.edited(t or "", after), distinct[d][0]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t or ""), brute.sha(new))
            assert r["fingerprint"] == spotsigs.fingerprint(t or "") and r["edited_fingerprint"] == spotsigs.fingerprint(new)
            assert r["near_edited"] == spotsigs.likeness(r["fingerprint"], r["edited_fingerprint"])
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_fingerprints_in_key_order(spark):
    docs = [(i, f"the house {i} of the word{i} and the tree{i % 7} was there " * (i % 5)) for i in range(300)]
    got = {r["doc_id"]: r for r in spotsigs.compare_with_next(table(spark, docs)).collect()}
    for d, t in docs:
        new = spotsigs.edited(t, docs[(d - 1) % 300][1])
        assert got[d]["edited_sha256"] == brute.sha(new)
        assert got[d]["near_next"] == spotsigs.likeness(spotsigs.fingerprint(t), spotsigs.fingerprint(docs[(d - 1) % 300][1]))


def test_fingerprints_empty(empty):
    assert rows(spotsigs.compare_with_next(empty)) == []


def test_near_pairs_equal_all_pairs(spark):
    prints = sorted({spotsigs.fingerprint(" ".join(f"the {w}" for w in t.split())) for _, t in near_copies(11)})
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fingerprint string")
    want = sorted((a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if spotsigs.likeness(a, b) >= 0.5)
    assert rows(spotsigs.near_pairs(df, 0.5), "a", "b") == want and want
    assert rows(spotsigs.near_pairs(df.limit(0), 0.5)) == []


def test_fingerprints_of_texts_without_anchors(spark):
    r = random.Random(8)
    russian = " ".join("".join(r.choice("абвгдежиклмнопрст") for _ in range(6)) for _ in range(60))
    chinese = "".join(chr(0x4e00 + r.randrange(900)) for _ in range(80))
    code = "\n".join(f"x{i} = f{i}(z{i * 7}, {i * 13})" for i in range(40))
    figures = " ".join(str(r.randrange(10_000)) for _ in range(60))
    english = "the cat sat there and the dog was not in the old house with other small animals " * 8
    few = "одно два три четыре пять шесть семь восемь девять десять"
    for i, t in enumerate((russian, chinese, code, figures, few)):
        for after in (english, english.replace("the ", "")[::-1]):
            docs = [(1, after), (2, t)]
            got = {x["doc_id"]: x for x in spotsigs.compare_with_next(table(spark, docs)).collect()}
            assert 0.1 < got[2]["near_edited"] < 0.9, (i, after[:20])
            assert got[2]["near_next"] < 0.1
    changed = {t: t[:-6] + "щ1 2" for t in (russian, chinese, code, figures)}
    prints = [(i, spotsigs.fingerprint(t)) for i, t in enumerate([*changed, *changed.values()])]
    pairs = spotsigs.near_pairs(spark.createDataFrame(prints, "doc_id long, fingerprint string"), 0.7)
    assert rows(pairs, "a", "b") == sorted(tuple(sorted((prints[i][1], prints[i + 4][1]))) for i in range(4))
    rows_of_table = ["kg 12 kg 13 kg 14 kg 15", "kg 22 kg 23 kg 24 kg 25"]
    assert spotsigs.likeness(*map(spotsigs.fingerprint, rows_of_table)) == 0
    assert [spotsigs.fingerprint(t)[0] == "=" for t in ("", " \n", "?!", "one")] == [True, True, False, False]


# --- packing

def first_plan(lengths, capacity):
    """Sequences that best-fit decreasing takes, document by document."""
    free = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, f in enumerate(free) if f >= n]
        if fit:
            i = min(fit, key=lambda i: free[i])
            free[i] -= n
        else:
            free.append(capacity - n)
    return len(free)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randint(1, 64), r.randint(1, 9), 64, 33]) for _ in range(400)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    place, seen = {}, {}
    for length, rank, count, sequence, offset, each in packing.plan(histogram, 64):
        for k in range(count):
            assert (length, rank + k) not in seen
            seen[length, rank + k] = True
            place.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
    assert len(seen) == len(lengths) and len(place) == first_plan(lengths, 64)
    for spans in place.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64


def test_packing(spark, edges, empty):
    got = packing.pack(packing.pieces(edges, BYTES, 100, with_ids=True), 100).collect()
    want, have = [], []
    for d, t in EDGES:
        ids = [*brute.token_ids(t), 0]
        want += [(d, p, s, ids[s:s + n]) for p, (s, n) in enumerate(packing.cut(len(ids), 100))]
    for r in got:
        have.append((r["doc_id"], r["piece"], r["start"], list(r["ids"])))
        assert r["ids_crc32"] == brute.crc(r["ids"]) and r["length"] == len(r["ids"]) <= 100
    assert sorted(have) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 100
    assert rows(packing.pack(packing.pieces(empty, BYTES, 100), 100)) == []


def test_encoder_equals_the_library():
    encoder = Encoder(BYTES)
    texts = [t or "" for _, t in EDGES] + ["  a\n\n b  ", "\n", "a\xa0b\xad ²ª", *(f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(0x20, 0x250))]
    for t in texts:
        assert np.array_equal(encoder.encode(t), encoder.by_library(t)), t[:50]


# --- training order

@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    a, b = (trainorder.permuted(np.arange(n), n, key) for key in (1, 2))
    assert sorted(a) == sorted(b) == list(range(n))
    assert n < 7 or list(a) != list(b) != list(range(n))


def test_shards_round_trip(spark, edges, empty):
    path = trainorder.materialise(edges, BYTES, 32, 50256, 7, 10)
    got = trainorder.digests(spark, path, 32, 10).orderBy("slot").collect()
    ids = {r["slot"]: list(r["ids"]) for r in trainorder.read_from(spark, path, 32).collect()}
    assert [r["slot"] for r in got] == list(range(len(got)))
    assert all(r["shard"] == r["slot"] // 10 and r["byte"] == r["slot"] % 10 * (10 + 64) for r in got)
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], []).append((r["piece"], ids[r["slot"]]))
    for d, t in EDGES:
        if sum(x == d for x, _ in EDGES) == 1:
            assert [i for _, p in sorted(texts[d]) for i in p] == [*brute.token_ids(t), 50256]
    resumed = trainorder.read_from(spark, path, 32, 25)
    assert sorted(r["slot"] for r in resumed.select("slot").collect()) == list(range(25, len(got)))
    nothing = trainorder.materialise(empty, BYTES, 32, 50256, 7, 10)
    assert rows(trainorder.digests(spark, nothing, 32, 10)) == []


# --- BPE

def test_bpe_equals_the_library(edges, empty):
    got = rows(bpe.digests(edges, WORDS))
    want = [(d, *b) for (d, _), b in zip(EDGES, brute.bpe([t for _, t in EDGES]), strict=True)]
    assert got == sorted(want, key=repr)
    full = bpe.encode(edges, WORDS).where("doc_id = 1").first()
    assert full["decoded"].split()[:3] == ["the</w>", "cat</w>", "sat</w>"] and len(full["ids"]) == len(full["decoded"].split())
    assert rows(bpe.digests(empty, WORDS)) == []


def test_bpe_random_texts():
    r = random.Random(9)
    coder = bpe.RankArrayBPE(WORDS)
    texts = ["".join(r.choice("abcde' .é1Ñ\n日\U0001F600\x1c") for _ in range(40)) for _ in range(800)] + ["ab" * 900, "é" * 400]
    assert [(n, brute.sha(i), brute.sha(d)) for i, d, n in map(coder.encode_shown, texts)] == brute.bpe(texts)
    word = "".join(r.choice("abcdefgh") for _ in range(90))
    parts = [coder.inner[b] for b in word.encode()]
    assert coder._by_scan(list(parts)) == coder._by_heap(list(parts))


# --- top-k

def vectors(seed, n=700, width=20):
    r = np.random.default_rng(seed)
    out = [(int(i), [float(x) for x in r.normal(size=width).astype(np.float32)]) for i in range(n)]
    out += [(1000 + i, out[3][1]) for i in range(60)]  # ties
    out += [(50, out[4][1]), (50, out[4][1]), (150, [0.0] * width)]  # repeated ids and rows
    return out


@pytest.mark.parametrize("block", [16_384, 100])
def test_top_k_equals_all_pairs(spark, block):
    data = vectors(1)
    odd = [(2000, None), (2001, [1.0, None] * 10), (2050, [float("nan")] * 20), (2100, [float("inf")] * 20), (None, [1.0] * 20)]
    df = table(spark, data + odd, "vec_id long, embedding array<float>")
    got = topk.search(df, 5, lambda v: v % 50 == 0, block=block)
    want = brute.top_k([(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in data], 5)
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_top_k_few_and_none(spark):
    few = table(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [])], "vec_id long, embedding array<float>")
    got = topk.search(few, 5, lambda v: v % 50 == 0)
    assert rows(got) == [(0, 1, 1, 256 * 128 + 512 * 128), (0, 2, 2, 0)]
    assert rows(topk.search(few.limit(0), 5, lambda v: v % 50 == 0)) == []
    large = table(spark, [(0, [4e6, 3e6]), (1, [4e6, 3e6]), (2, [4e6, 3e6 + 1])], "vec_id long, embedding array<double>")
    assert [r[2] for r in rows(topk.search(large, 2, lambda v: v == 0))] == [2, 1]


# --- licences

def test_license_scan(spark, edges, empty):
    got = rows(licenses.scan(edges), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((d, *brute.license_base(t)) for d, t in EDGES), key=repr)
    of = {r["doc_id"]: r for r in licenses.scan(edges).collect()}
    assert of[14]["labels"] == "gpl,lgpl,mit" and of[14]["score"] > 0.7
    assert of[1]["labels"] == "" and of[1]["score"] == 0
    assert rows(licenses.scan(empty)) == []


def test_license_needs_its_phrase_and_place(spark):
    bsd = licenses.TEMPLATES[7][1]
    shuffled = bsd.split()
    random.Random(1).shuffle(shuffled)
    docs = [(1, f"some words before {bsd} and after"), (2, " ".join(shuffled)), (3, bsd.replace("source and", "source or")),
            (4, bsd.replace("are permitted", "are now permitted")), (5, "mit mit license license general public public license")]
    of = {r["doc_id"]: r["labels"] for r in licenses.scan(table(spark, docs)).collect()}
    assert of == {1: "bsd", 2: "", 3: "", 4: "bsd", 5: "mit"}


def test_licenses_beside_each_other(spark):
    mit, bsd = licenses.TEMPLATES[0][1], licenses.TEMPLATES[7][1]
    every = " ".join(w for i in range(40) for _, t, _ in licenses.TEMPLATES for w in t.split()[i::40] * 50)
    docs = [(1, f"{mit}. {bsd}."), (2, f"{every} {bsd} {every}"), (3, " and ".join(t for _, t, _ in licenses.TEMPLATES)),
            (4, f"{mit} {'plain words of a file ' * 2000} {mit.replace('deal in', 'trade with')}"), (5, every)]
    of = {r["doc_id"]: r for r in licenses.scan(table(spark, docs)).collect()}
    assert of[1]["labels"] == "bsd,mit" and of[1]["score"] == 1
    assert "bsd" in of[2]["labels"].split(",") and of[2]["score"] == 1
    assert of[3]["labels"] == ",".join(sorted({label for label, _, _ in licenses.TEMPLATES}))
    assert of[4]["labels"] == "mit" and "bsd" not in of[5]["labels"].split(",")
