"""Fill-in-middle against a plain version, in every unit and over portions of any size."""

import hashlib
import random
import re
import sys
from pathlib import Path

import pyarrow as pa
import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

from test_operators import EDGES, empty, rows, spark, table  # noqa: E402, F401

from crawlatlas.llm import common, fim  # noqa: E402

MORE = [(20, "a <P> marker"), (21, "<S"), (22, "ends with <"), (23, "<M>"), (24, "\nline\n\nand  words \n"), (25, "日本\U0001f600語 é́"),
        (None, "no key"), (None, None), (26, "> P><S <"), *[(i, f"text number {i} of many, {i * i} in all") for i in range(100, 400)]]


def plain_version(key, text, percent=90, spm_percent=20, seed=1, unit="char"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    space = " \t\n\x0b\x0c\r"
    units = list(text) if unit == "char" else re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else re.findall(
        rf"[{space}]*[^{space}]+[{space}]*|[{space}]+", text)
    if unit == "word":  # leading white space is a unit of its own
        units = [u for x in units for u in ([x] if x[0] not in space or x.strip(space) == "" else [x[:len(x) - len(x.lstrip(space))], x.lstrip(space)])]
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in fim.MARKERS) or h3 % 100 >= percent:
        return key, n, "plain", None, None, text, text
    if h4 % 100 < spm_percent:
        return key, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", text
    return key, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_equals_the_plain_version(spark, unit):  # noqa: F811
    data = EDGES + MORE
    got = rows(fim.restore(fim.transform(table(spark, data), unit=unit)))
    assert got == sorted((plain_version(k, t, unit=unit) for k, t in data), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_rates_seeds_and_small_portions(spark, monkeypatch):  # noqa: F811
    monkeypatch.setattr(common.portions, "__defaults__", (64,))
    got = rows(fim.restore(fim.transform(table(spark, MORE), percent=50, spm_percent=100, seed=7)))
    assert got == sorted((plain_version(k, t, 50, 100, 7) for k, t in MORE), key=repr)


def test_empty_table(spark, empty):  # noqa: F811
    assert rows(fim.restore(fim.transform(empty))) == []


def test_units_of_a_slice_share_its_bytes():
    texts = pa.array(["skipped", "é a", "", "日本 "]).slice(1)
    for unit, want in (("char", [list("é a"), [], list("日本 ")]), ("word", [["é ", "a"], [], ["日本 "]])):
        assert fim.units_of(texts, unit).to_pylist() == want


def test_portions():
    texts = pa.array(["ab", None, "c", "d" * 10, "", "ef"])
    assert list(common.portions(texts, 3)) == [(0, 3), (3, 4), (4, 6)]
    r = random.Random(3)
    long = pa.array(["x" * r.randrange(20) for _ in range(200)])
    cuts = list(common.portions(long, 30))
    assert [a for a, _ in cuts] == [0, *[b for _, b in cuts[:-1]]] and cuts[-1][1] == 200
    assert all(sum(map(len, long[a:b].to_pylist())) <= 30 or b == a + 1 for a, b in cuts)
