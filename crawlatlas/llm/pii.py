"""Personal data by bootstrapped contextual extraction.

Base patterns find seed entities. What stands around an entity gives its lexical patterns: the one or
two words before it, the last word with the signs behind it, the words on both sides, and the word
behind it at the start of a line. Other tokens that could be an identifier (7 to 25 digits, or a
spelt-out at sign) and stand in the same patterns are unseen instances. Patterns of addresses and of
numbers are kept apart. Spark scores the graph of patterns and instances in turns: a pattern is worth
the share of its instances that are of a kind, an instance is worth what its best pattern makes
likely, and seeds keep their kind. Patterns that hold enough different seeds and are nearly always of
one kind are sure; their instances become spans of that kind, and seeds of the next generation, until
a generation adds none.

Defined results: null text is the empty text and has no spans; repeated rows each get a result; an
empty table gives none; extra columns are left out (``redact`` keeps all columns).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlatlas.llm.common import CHUNK, materialize, tidy

KINDS = ("email", "ip", "card", "phone")
#: Turns of scoring a generation; what a pattern needs: different seeds, and share of its occurrences of one kind.
TURNS, MIN_SEEDS, MIN_SHARE = 3, 5, 0.9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\W\d_]+")
# Tokens that could be identifiers: digits with signs between them, or "name at host dot tld".
CANDIDATE = re.compile(r"[0-9](?:[\x20()./-]{0,2}[0-9]){6,24}|[\w.+-]{1,64} ?(?:\(at\)|\[at\]) ?[\w-]{1,64}(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]{1,64})+")
CONTEXT = 48


def emails(text: str) -> list[tuple[int, int]]:
    """From at sign to at sign instead of from letter to letter, so that long runs cost linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        free = match.end() if match else at + 1
        if match:
            out.append((start, free))
        at = text.find("@", free)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Runs of dotted numbers, four by four."""
    out = []
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m.group())) <= 15] if "+" in text else []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; offsets in code points."""
    numbers = DIGIT.search(text) is not None
    found = [emails(text), ips(text) if numbers else [], cards(text) if numbers else [], phones(text) if numbers else []]
    return [(kind, a, b) for kind, spans in enumerate(found) for a, b in spans]


def patterns_around(text: str, start: int, end: int, address: bool) -> list[str]:
    """Lexical patterns of a place: words before it, signs between, the word behind it, the start of a line."""
    kind = "a" if address else "n"
    words = list(WORD.finditer(text, max(0, start - CONTEXT), start))[-2:]
    right = WORD.search(text, end, end + CONTEXT)
    after = right.group().lower() if right else ""
    out = []
    if words:
        last = words[-1].group().lower()
        out.append(f"{kind}<{last}")
        if len(words) == 2:
            out.append(f"{kind}<{words[0].group().lower()} {last}")
        signs = "".join(text[words[-1].end():start].split())
        if signs:
            out.append(f"{kind}<{last}{signs}")
        if after:
            out.append(f"{kind}<{last}>{after}")
    line = text.rfind("\n", max(0, start - CONTEXT), start) + 1
    if after and (line or start <= CONTEXT) and not text[line:start].strip():
        out.append(f"{kind}^>{after}")
    return out


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, str, int | None, int, int]]:
    """(pattern, value, kind of a seed or None, start, end) of seeds and of possible instances."""
    out = []
    taken = sorted((a, b) for _, a, b in base)
    found: list[tuple[int | None, int, int]] = list(base)
    if DIGIT.search(text) or "at" in text:
        i = 0
        for m in CANDIDATE.finditer(text):
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if i == len(taken) or taken[i][0] >= m.end():
                found.append((None, *m.span()))
    for kind, a, b in found:
        shown_as = text[a:b].lower()
        value = re.sub(r"[\s().-]", "", shown_as)
        address = kind == 0 or kind is None and ("(at)" in shown_as or "[at]" in shown_as)
        out += [(p, value, kind, a, b) for p in patterns_around(text, a, b, address)]
    return out


SPAN = "struct<kind:int,start:int,end:int>"
SEEN = "struct<pattern:string,value:string,kind:int,start:int,end:int>"


def spans_of_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, t1, t2 (hashes that name the text), base (spans) and seen (occurrences) of every row."""

    @tidy
    def run(batches):
        for batch in batches:
            texts = batch.column(3)
            for at in range(0, len(texts), CHUNK):
                base, seen = [], []
                for t in texts.slice(at, CHUNK).to_pylist():
                    own = base_spans(t)
                    base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                    seen.append([dict(zip(("pattern", "value", "kind", "start", "end"), o, strict=True))
                                 for o in occurrences(t, own)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(at, CHUNK) for i in range(3)]
                    + [pa.array(base, pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end")]))),
                       pa.array(seen, pa.list_(pa.struct([("pattern", pa.string()), ("value", pa.string()),
                                                          *[(n, pa.int32()) for n in ("kind", "start", "end")]])))],
                    ["key", "t1", "t2", "base", "seen"])

    kind = docs.schema[key].dataType.simpleString()
    whole = F.coalesce(F.col(text), F.lit(""))
    return (docs.select(F.col(key).alias("key"), *text_hashes(text), whole.alias("text"))
            .mapInArrow(run, f"key {kind}, t1 long, t2 long, base array<{SPAN}>, seen array<{SEEN}>"))


def text_hashes(text: str) -> list:
    """Two hashes that together name a text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit("text"), whole).alias("t2")]


def scored_patterns(edges: DataFrame, known: DataFrame, turns: int = TURNS) -> DataFrame:
    """pattern, seeds (different ones) and share_0 to share_3 (by kind) after scoring the graph in turns.

    ``edges`` has pattern, value and n, ``known`` the kind of the values that are seeds.
    """
    kinds = range(len(KINDS))
    edges = edges.join(known, "value", "left")
    scores = edges.groupBy("value").agg(F.max("kind").alias("kind")).select(
        "value", "kind", *[F.when(F.col("kind") == k, 1.0).otherwise(0.0).alias(f"s_{k}") for k in kinds])
    for turn in range(turns):
        weighed = edges.select("pattern", "value", "n").join(scores, "value")
        patterns = weighed.groupBy("pattern").agg(
            F.count("kind").alias("seeds"), F.sum("n").alias("rows"),
            *[F.sum(F.col("n") * F.col(f"s_{k}")).alias(f"w_{k}") for k in kinds])
        patterns = patterns.select("pattern", "seeds", *[(F.col(f"w_{k}") / F.col("rows")).alias(f"share_{k}") for k in kinds])
        patterns = materialize(patterns.where("seeds > 0"), "patterns")
        if turn + 1 == turns:
            return patterns
        # The best pattern speaks for an instance, as the patterns of one place are no independent witnesses.
        worth = [F.max(F.col(f"share_{k}") * F.col("seeds") / (F.col("seeds") + 1)).alias(f"u_{k}") for k in kinds]
        unseen = (edges.where(F.col("kind").isNull()).select("pattern", "value").join(patterns, "pattern")
                  .groupBy("value").agg(*worth))
        scores = scores.select("value", "kind", *[F.col(f"s_{k}").alias(f"o_{k}") for k in kinds]).join(unseen, "value", "left")
        scores = materialize(scores.select("value", "kind", *[
            F.when(F.col("kind").isNotNull(), F.col(f"o_{k}")).otherwise(F.coalesce(F.col(f"u_{k}"), F.lit(0.0))).alias(f"s_{k}")
            for k in kinds]), "scores")
    raise ValueError("turns must be at least 1")


def sure_patterns(seen: DataFrame, turns: int = TURNS, min_seeds: int = MIN_SEEDS, min_share: float = MIN_SHARE) -> DataFrame:
    """pattern, p_kind and p_share of the sure patterns of all generations.

    Each generation adds seeds, of which there are no more than values, so the turns end.
    """
    edges = seen.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"))
    edges = materialize(edges, "edges")
    known = edges.groupBy("value").agg(F.max("kind").alias("kind")).where("kind IS NOT NULL")
    edges, sure, best = edges.drop("kind"), None, F.greatest(*[F.col(f"share_{k}") for k in range(len(KINDS))])
    kind = F.coalesce(*[F.when(F.col(f"share_{k}") == best, F.lit(k)) for k in range(len(KINDS))])
    while True:
        own = scored_patterns(edges, known, turns).where((F.col("seeds") >= min_seeds) & (best >= min_share)).select(
            "pattern", kind.alias("p_kind"), best.alias("p_share"))
        # A pattern keeps the kind that it was first sure of.
        sure = own if sure is None else sure.unionByName(own.join(sure, "pattern", "left_anti"))
        sure = materialize(sure, "sure")
        added = (edges.join(known, "value", "left_anti").join(sure, "pattern").groupBy("value")
                 .agg(F.max_by("p_kind", F.struct("p_share", "p_kind")).alias("kind")))
        added = materialize(added, "added")
        if added.isEmpty():
            return sure
        known = materialize(known.unionByName(added), "known")


def discovered(rows: DataFrame, turns: int = TURNS, min_seeds: int = MIN_SEEDS, min_share: float = MIN_SHARE) -> DataFrame:
    """t1, t2 and found (spans that patterns add), one row for each text that has any."""
    seen = rows.select("t1", "t2", F.explode("seen").alias("o")).select("t1", "t2", "o.*")
    sure = sure_patterns(seen, turns, min_seeds, min_share)
    hits = (seen.where(F.col("kind").isNull()).select("t1", "t2", "pattern", "start", "end").distinct()
            .join(sure, "pattern")
            .groupBy("t1", "t2", "start", "end").agg(F.max_by("p_kind", F.struct("p_share", "p_kind")).alias("kind")))
    # A list per text; a text's spans are bounded by its length.
    out = hits.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("found"))
    return materialize(out, "found")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """key, base (spans of the base patterns) and spans (those and the discovered ones)."""
    rows = materialize(spans_of_rows(docs, key, text), "rows")
    found = discovered(rows, **bounds)
    both = rows.drop("seen").join(found, ["t1", "t2"], "left")
    spans = F.sort_array(F.concat("base", F.coalesce("found", F.array().cast(f"array<{SPAN}>"))))
    return both.select(F.col("key").alias(key), "base", spans.alias("spans"))


def count_of(spans: str, kind: str):
    """How many of the spans are of a kind."""
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def shown(spans: str):
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans are replaced together."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """The rows of ``docs``, all columns, with personal data in ``text`` masked. Null text stays null."""
    found = discovered(materialize(spans_of_rows(docs, key, text).select("t1", "t2", "seen"), "rows"), **bounds)
    # The row travels as one column, so that its names cannot clash with those in use here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), *text_hashes(text))
    joined = rows.join(found.select(F.col("t1").alias("f1"), F.col("t2").alias("f2"), "found"),
                       (F.col("t1") == F.col("f1")) & (F.col("t2") == F.col("f2")), "left")
    extra = "found"
    while extra in docs.columns:
        extra += "_"
    joined = joined.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("found").alias(extra))
    at = docs.columns.index(text)

    @tidy
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                out = []
                for t, more in zip(part.column(at).to_pylist(), part.column(len(docs_names)).to_pylist(), strict=True):
                    spans = base_spans(t or "") + [(s["kind"], s["start"], s["end"]) for s in more or ()]
                    out.append(masked(t, spans) if spans else t)
                columns = part.columns[:len(docs_names)]
                columns[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, docs_names)

    docs_names = list(docs.columns)
    return joined.mapInArrow(run, docs.schema)
