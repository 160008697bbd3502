"""Fill-in-middle transformation by whole columns in ``pyarrow.compute``.

The texts of a portion become one list array of units (code points, words or lines). Flattened, every
unit knows its parent row and its ordinal there; two cuts per row give it a role (prefix, middle or
suffix). Units are filtered by role, made lists again and joined, and the three pieces are joined with
the markers in the order of the row's form. Nothing loops over rows or units in Python.

A row's cuts and form come from the hash of its key, so any task gives the same result again. Work goes
by portions of bounded bytes; only a text that is longer than that is worked on alone.

Defined results: null text is the empty text, which is plain; texts that hold a marker are plain, as
they could not be told apart again; a null key hashes as if it were empty; equal rows give equal
results; an empty table gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlatlas.llm.common import portions, text_or_empty

MARKERS = ("<P>", "<S>", "<M>")
RESULT = "n long, form string, prefix_units long, middle_units long, output string"


def units_of(texts: pa.Array, unit: str = "char") -> pa.ListArray:
    """The units of every text as a list array over the bytes of ``texts``, none of which is copied.

    ``char`` is a code point, ``line`` ends with its line feed, and ``word`` ends with the white space behind it.
    """
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2] or pa.py_buffer(b"")
    all_bytes = np.frombuffer(data, np.uint8)[:at[-1]]
    if unit == "char":
        first = (all_bytes & 0xC0) != 0x80
    else:
        ends = all_bytes == 10 if unit == "line" else (all_bytes == 32) | ((all_bytes >= 9) & (all_bytes <= 13))
        first = np.zeros(len(all_bytes), bool)
        first[1:] = ends[:-1] if unit == "line" else ends[:-1] & ~ends[1:]
        first[at[:-1][at[:-1] < at[1:]]] = True
    starts = np.flatnonzero(first[at[0]:]).astype(np.int32) + at[0]
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, at[-1]).astype(np.int32)), data)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, at).astype(np.int32)), flat)


def pieces_of(units: pa.ListArray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of every row; the first two end before unit ``low`` and ``high``."""
    parents = pc.list_parent_indices(units).to_numpy()
    flat = pc.list_flatten(units)
    ordinals = np.arange(len(flat)) - units.offsets.to_numpy()[parents]
    role = (ordinals >= low[parents]).astype(np.int8) + (ordinals >= high[parents])
    pieces = []
    for wanted in range(3):
        mine = role == wanted
        ends = np.cumsum(np.bincount(parents[mine], minlength=len(units)))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), flat.filter(pa.array(mine)))
        pieces.append(pc.binary_join(lists, ""))
    return pieces


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 90, spm_percent: int = 20,
              seed: int = 1, unit: str = "char", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """key, n (units), form (plain, psm or spm), prefix_units, middle_units (null if plain) and output.

    ``percent`` of the texts are cut, and of those ``spm_percent`` have the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    p, s, m = markers

    def run(batches):
        for batch in batches:
            for start, stop in portions(batch.column(1)):
                part = batch.slice(start, stop - start)
                texts = part.column(1)
                h1, h2, h3, h4 = (part.column(2 + i).to_numpy() for i in range(4))
                units = units_of(texts, unit)
                n = np.diff(units.offsets.to_numpy()).astype(np.int64)
                low, high = (f(h1 % (n + 1), h2 % (n + 1)) for f in (np.minimum, np.maximum))
                prefix, middle, suffix = pieces_of(units, low, high)
                marked = np.zeros(len(n), bool)
                for marker in markers:
                    marked |= pc.match_substring(texts, marker).to_numpy(zero_copy_only=False)
                plain = (n == 0) | marked | (h3 % 100 >= percent)
                spm = ~plain & (h4 % 100 < spm_percent)
                output = pc.case_when(
                    pc.make_struct(pa.array(plain), pa.array(spm)), texts,
                    pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, ""),
                    pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, ""))
                form = pc.case_when(pc.make_struct(pa.array(plain), pa.array(spm)), "plain", "spm", "psm")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), form, pa.array(low, mask=plain), pa.array(high - low, mask=plain), output],
                    ["key", "n", "form", "prefix_units", "middle_units", "output"])

    asked = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"), *groups)
    kind = docs.schema[key].dataType.simpleString()
    return asked.mapInArrow(run, f"key {kind}, {RESULT}").withColumnRenamed("key", key)


def _halves(texts: pa.Array, marker: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and behind the first ``marker`` of every text."""
    both = pc.split_pattern(texts, marker, max_splits=1)
    return pc.list_element(both, 0), pc.list_element(both, 1)


def restore(rows: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``rows`` of ``transform`` with ``restored``, the text rebuilt from ``output`` and ``form`` alone."""
    p, s, m = markers
    names = rows.columns
    form_at, output_at = names.index("form"), names.index("output")

    def rebuilt(form: pa.Array, output: pa.Array) -> pa.Array:
        out = output
        for kind, first, second in (("psm", p, s), ("spm", s, p)):
            mine = pc.equal(form, kind)
            cut = pc.utf8_slice_codeunits(output.filter(mine), len(first))
            before, rest = _halves(cut, second)
            behind, middle = _halves(rest, m)
            prefix, suffix = (before, behind) if kind == "psm" else (behind, before)
            out = pc.replace_with_mask(out, mine, pc.binary_join_element_wise(prefix, middle, suffix, ""))
        return out

    def run(batches):
        for batch in batches:
            for start, stop in portions(batch.column(output_at)):
                part = batch.slice(start, stop - start)
                texts = rebuilt(part.column(form_at), part.column(output_at))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*names, "restored"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, restored string")
