"""The registered queries over whole tables: against their SQL, or against brute force."""

import importlib
import sys
from pathlib import Path

import duckdb
import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from crawlatlas.llm import pii  # noqa: E402
from crawlatlas.llm.queries import QUERIES, SQL  # noqa: E402
from crawlatlas.session import build_session  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def spark():
    session = build_session("local[4]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()


def result(spark, key):
    return {r["doc_id"]: r for r in QUERIES[key](spark, SF).collect()}


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql(spark, con, key):
    df = QUERIES[key](spark, SF)
    cursor = con.execute(SQL[key])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_points_register_every_query():
    entry = importlib.import_module("__spark_entry__")
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_jaccard_join(spark, docs):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in QUERIES["op1_ngram_jaccard_join"](spark, SF).collect())
    assert got == brute.groups(docs, 3, 90)


def test_pii(spark, docs):
    got = result(spark, "op3_pii")
    for d, t in docs:
        want = brute.pii(t)
        counts = tuple(sum(s.startswith(k + ":") for s in want) for k in pii.KINDS)
        assert tuple(got[d][f"n_{k}"] for k in pii.KINDS) == counts
        assert got[d]["base_sha256"] == brute.sha(",".join(want))
        assert set(want) <= {*got[d]["spans"].split(",")} | {""}


def test_language_of_held_out_rows(spark, con):
    got = result(spark, "op4_language_id")
    truth = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    held = [r for r in got.values() if r["held_out"]]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.97


def test_fingerprints(spark, docs):
    got = result(spark, "op5_spotsigs")
    for (d, t), (_, after) in zip(docs[::-1], [*docs[::-1][1:], docs[-1]], strict=True):
        half = len(t) // 2
        assert got[d]["edited_sha256"] == brute.sha(t[:len(t) - half] + after[:half])


def test_packing(spark, docs):
    by, sequences, tokens = {}, {}, 0
    for r in QUERIES["op6_best_fit_packing"](spark, SF).collect():
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, t in docs:
        ids, at = [*brute.token_ids(t), 0], 0
        for piece, start, length, crc in sorted(by[d]):
            assert start == at and (length == 2048 or piece == 0) and brute.crc(ids[at:at + length]) == crc
            at += length
        assert at == len(ids)
        tokens += at
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-tokens // 2048) + 1


def test_training_order(spark, docs):
    got = QUERIES["op7_training_order"](spark, SF).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    assert len(got) == sum(-(-(len(brute.token_ids(t)) + 1) // 512) for _, t in docs)


def test_bpe(spark, docs):
    got = result(spark, "op8_bpe")
    for (d, _), want in zip(docs, brute.bpe([t for _, t in docs]), strict=True):
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == want


def test_licenses(spark, docs):
    got = result(spark, "op10_license_scan")
    for d, t in docs:
        assert tuple(got[d][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute.license_base(t)


def test_pipeline_stages(spark, con, docs):
    """Each stage against brute force on what its predecessor kept."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(docs)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.materialize(stage(spark, df, SF), name)
        assert df.columns == corpus_pipeline.COLUMNS
        kept.append({r["doc_id"]: r["text"] for r in df.collect()})
    assert kept[0] == {d: t for d, t in texts.items() if any(c.isalpha() for c in t or "")}
    groups = brute.groups(sorted(kept[0].items()), 5, 80)
    assert kept[1] == {d: texts[d] for d, _, c in groups if d == c}
    for d, t in kept[2].items():
        spans = [s.split(":") for s in brute.pii(kept[1][d])]
        assert t == pii.masked(kept[1][d], [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in spans])
    assert set(kept[2]) == set(kept[1])
    packed = corpus_pipeline.STAGES[-1][1](spark, df, SF)
    lengths = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert lengths == {d: len(brute.token_ids(t)) + 1 for d, t in kept[2].items()}
    assert corpus_pipeline.ORACLE_SQL is None
