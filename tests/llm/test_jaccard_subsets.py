"""What the Jaccard join gives up and compares a second time, against brute force and plain counts."""

import random
import sys
from fractions import Fraction
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

import brute  # noqa: E402

from crawlatlas.llm import jaccard  # noqa: E402
from crawlatlas.session import build_session  # noqa: E402

SIMILAR = Fraction(8, 10)


@pytest.fixture(scope="module")
def spark():
    session = build_session("local[4]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def compared(monkeypatch):
    """Numbers of rows that are given to comparison by sketches."""
    counts, near_pairs = [], jaccard.near_pairs

    def counted(rows, *rest):
        counts.append(rows.count())
        return near_pairs(rows, *rest)

    monkeypatch.setattr(jaccard, "near_pairs", counted)
    return counts


def components_of(spark, docs):
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 5, SIMILAR)
    return sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_pairs_compared_with_the_centre_are_not_compared_again(spark, compared):
    r = random.Random(1)
    base = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    half = base[:1900] + [f"v{r.randrange(10**6)}" for _ in range(1100)]
    docs = [(1, " ".join(base)), (2, " ".join(half))]
    assert components_of(spark, docs) == sorted(brute.groups(docs, 5, 80), key=repr)
    assert compared == [0]


def test_long_sets_can_give_up_their_empty_segments():
    band = jaccard.allocate({21: (1768, 10_655_544)}, SIMILAR).bands[21]
    empty = band.segments * 2.718 ** -(10_655_544 / 1768 / band.segments)
    assert empty < band.near < 3 * empty


def test_allocation_of_very_large_and_of_nearly_equal_sets():
    assert jaccard.allocate({36: (100, 250_000_000)}, SIMILAR).bands[36].near < jaccard.SEGMENTS
    assert jaccard.allocate({19: (100, 250_000)}, Fraction(9999, 10000)).bands[19].segments == 1


def keyed(segment, number):
    return 14 << 52 | segment << 40 | number


def test_each_set_gives_up_its_dearest_subsets(spark):
    scheme = jaccard.Scheme(SIMILAR, {14: jaccard.Band(14, 110, 3)})
    # Set 1 has subsets of 2 to 6 rows and one of its own; 0 is a segment with a neighbourhood, which counts twice.
    shared = {keyed(0, 1): 6, keyed(0, 2): 5, keyed(50, 1): 4, keyed(51, 1): 3, keyed(52, 1): 2, keyed(53, 1): 1}
    other = iter(range(100, 200))
    hits = [(k, 1, 400) for k in shared] + [(k, next(other), 400) for k, n in shared.items() for _ in range(n - 1)]
    kept = jaccard._without_dearest(spark.createDataFrame(hits, "key long, rep long, size long"), scheme, 1)
    assert sorted(r["key"] for r in kept.where("rep = 1").collect()) == [keyed(51, 1), keyed(52, 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_link_is_lost_by_what_sets_give_up(spark, monkeypatch, seed):
    """Neighbourhoods on many segments, as large tables have them, so that each set gives up all it may."""
    monkeypatch.setattr(jaccard, "COMPARED", 1000.0)
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    docs = []
    for size in [12, 30, 60, 60, 150, 150, 300]:
        base = [word() for _ in range(size)]
        for _ in range(8):
            text = list(base)
            for _ in range(r.choice([0, 1, 2, size // 60, size // 45, size // 30])):
                text[r.randrange(size)] = word()
            docs.append(" ".join(text))
    docs = list(enumerate(docs, 1))
    gave_up = []
    without = jaccard._without_dearest

    def counted(hits, scheme, hot):
        kept = without(hits, scheme, hot)
        gave_up.append((max(b.near for b in scheme.bands.values()), hits.count(), kept.count()))
        return kept

    monkeypatch.setattr(jaccard, "_without_dearest", counted)
    assert components_of(spark, docs) == sorted(brute.groups(docs, 5, 80), key=repr)
    near, before, after = gave_up[0]
    assert near > 0 and after < before
