"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled text. A text is
parsed against each automaton into the longest phrases that stand in the sample; the language that
needs the fewest phrases, normalised by the length of the text and of the sample, wins.

The sample is bounded by two documented parameters: ``sample_chars`` a language and ``total_chars``
over all of them (beyond ``total_chars / sample_chars`` languages each gets less). It is taken in
the order of a hash of the key, so it does not depend on how rows are laid out. Every character of a
text to be predicted is parsed, every letter of the sample being a symbol of its own, in any script; phrases do not cross windows of ``WINDOW`` characters, which lets all
windows of a batch step through the automata together.

Defined results: null text or text without a letter is ``und`` with score 0; ties go to the language
whose name sorts first; repeated rows each get a result; without labelled rows all is ``und``; extra
columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlatlas.llm.common import tidy

WINDOW = 256
#: Symbols with a column of their own: 0 is the gap between words, the last one a letter that no sample has.
#: Letters beyond the most frequent ones are symbols from SYMBOLS on, whose transitions are kept as a sorted list.
SYMBOLS = 48
#: Characters that are parsed together; bounds the memory of a task.
TOGETHER = 1_500_000


def suffix_automaton(codes: np.ndarray, symbols: int, beyond: list | None = None) -> np.ndarray:
    """Transitions [state, symbol] of the automaton of all substrings; -1 where there is none.

    Those of symbols without a column are appended to ``beyond`` as (state, symbol, next state).
    """
    steps: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in codes.tolist():
        new = len(steps)
        steps.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.full((len(steps), symbols), -1, np.int32)
    for state, found in enumerate(steps):
        for c, to in found.items():
            if c < symbols:
                table[state, c] = to
            else:
                beyond.append((state, c, to))
    return table


@dataclass
class Model:
    languages: list[str]
    code_of: np.ndarray     # symbol of each code point
    table: np.ndarray       # transitions of all automata, one below the other
    roots: np.ndarray       # first state of each
    bits: np.ndarray        # log2 of the sample's length: what it takes to point to a phrase
    first: np.ndarray       # transitions of the roots [language, symbol], for all symbols
    beyond: np.ndarray      # sorted state * symbols + symbol of the transitions that the table has no column for
    beyond_to: np.ndarray   # next state of each

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states of [language, lane] by the symbols of the lanes; -1 where there is none."""
        far = np.flatnonzero(symbol >= SYMBOLS)
        if not len(far):
            return self.table.ravel()[state * SYMBOLS + symbol].astype(np.int64)
        to = self.table.ravel()[state * SYMBOLS + np.minimum(symbol, SYMBOLS - 1)].astype(np.int64)
        # A language whose root has no transition by a symbol has none at all.
        row, lane = np.nonzero(self.first[:, symbol[far]] >= 0)
        lane = far[lane]
        wanted = state[row, lane] * self.first.shape[1] + symbol[lane]
        at = np.minimum(np.searchsorted(self.beyond, wanted), len(self.beyond) - 1)
        to[row, lane] = np.where(self.beyond[at] == wanted, self.beyond_to[at], -1)
        return to

    def codes(self, text: str) -> np.ndarray:
        """Symbols of the lower-cased text, with one gap between words."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        found = self.code_of[points]
        gap = found == 0
        return found[~(gap & np.concatenate([[True], gap[:-1]]))] if len(found) else found

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text [column] takes in each language [row]."""
        lanes_of = [-(-len(t) // WINDOW) for t in texts]
        total = sum(lanes_of)
        grid = np.zeros((total, WINDOW), np.int32)
        length, owner = np.full(total, WINDOW), np.repeat(np.arange(len(texts)), lanes_of)
        flat, at = grid.ravel(), 0
        for t, lanes in zip(texts, lanes_of, strict=True):
            flat[at * WINDOW:at * WINDOW + len(t)] = t
            at += lanes
            if lanes:
                length[at - 1] = len(t) - (lanes - 1) * WINDOW
        order = np.argsort(-length, kind="stable")
        columns, length, owner = np.ascontiguousarray(grid[order].T), length[order], owner[order]
        n, root = len(self.languages), self.roots[:, None].astype(np.int64)
        state = np.repeat(root, total, axis=1)
        count = np.zeros((n, total), np.int32)
        for step in range(WINDOW):
            active = int(np.searchsorted(-length, -step, side="left"))
            if not active:
                break
            symbol = columns[step, :active]
            now = state[:, :active]
            to = self.step(now, symbol)
            ended = to < 0
            # A phrase ends before this character, which begins the next one. A character that the
            # sample does not have is a phrase by itself.
            again = self.first[:, symbol]
            count[:, :active] += ended & (now != root)
            alone = again < 0
            count[:, :active] += ended & alone
            to = np.where(ended, np.where(alone, root, again), to)
            state[:, :active] = to
        count += state != root
        out = np.zeros((n, len(texts)), np.int64)
        for k in range(n):
            out[k] = np.bincount(owner, count[k], len(texts))[:len(texts)]
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        codes = [self.codes(t) for t in texts]
        counted = self.phrases(codes)
        out = []
        for k, t in enumerate(codes):
            if not self.languages or not np.any(t):
                out.append(("und", 0.0))
                continue
            cost = counted[:, k] * self.bits / len(t)
            best = int(np.argmin(cost))
            rest = np.delete(cost, best)
            out.append((self.languages[best], float(1 - cost[best] / rest.min()) if len(rest) else 1.0))
        return out


def learn(samples: dict[str, list[str]], sample_chars: int) -> Model:
    """A model of the given texts, of which at most ``sample_chars`` symbols a language are used."""
    languages = sorted(samples)
    counts: dict[str, int] = {}
    for texts in samples.values():
        for t in texts:
            for c in t.lower():
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
    letters = sorted(counts, key=lambda c: (-counts[c], c))
    letter = np.array([chr(p).isalpha() for p in range(0x110000)])
    code_of = np.where(letter, SYMBOLS - 1, 0).astype(np.int32)
    for i, c in enumerate(letters):
        code_of[ord(c)] = i + 1 if i < SYMBOLS - 2 else i + 2
    symbols = max(SYMBOLS, len(letters) + 2)
    none = np.zeros(0, np.int64)
    model = Model(languages, code_of, np.zeros((0, SYMBOLS), np.int32), none, np.zeros(0),
                  np.full((len(languages), symbols), -1, np.int64), none, none)
    tables, roots, bits, states, beyond = [], [], [], 0, [np.zeros((0, 2), np.int64)]
    for k, language in enumerate(languages):
        codes = np.concatenate([np.zeros(0, np.int32), *map(model.codes, samples[language])])[:sample_chars]
        far: list[tuple[int, int, int]] = []
        table = suffix_automaton(codes, SYMBOLS, far)
        tables.append(np.where(table >= 0, table + states, -1).astype(np.int32))
        model.first[k, :SYMBOLS] = tables[-1][0]
        if far:
            state, symbol, to = np.array(far, np.int64).T
            beyond.append(np.stack([(state + states) * symbols + symbol, to + states], axis=1))
            model.first[k, symbol[state == 0]] = to[state == 0] + states
        roots.append(states)
        bits.append(np.log2(max(2, len(codes))))
        states += len(table)
    if tables:
        model.table = np.concatenate(tables)
    every = np.concatenate(beyond)
    model.beyond, model.beyond_to = every[np.argsort(every[:, 0])].T.copy()
    model.roots, model.bits = np.array(roots, np.int64), np.array(bits)
    return model


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from learning; a null key is neither held out nor learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, sample_chars: int = 40_000, total_chars: int = 400_000, key: str = "doc_id",
           text: str = "text", lang: str = "lang", languages: int = 1000) -> tuple[dict[str, list[str]], int]:
    """Labelled texts by language and the symbols of them to use.

    The ``languages`` labels with the most rows (ties by label) are learnt. Of rows with one key and label,
    the smallest text counts.
    Per language, at most ``sample_chars / 400`` rows of at least 400 characters are taken, by the
    hash of their key; each task passes on no more than that.
    """
    most = max(1, sample_chars // 400)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    counts = labelled.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    names = [r["lang"] for r in counts.orderBy(F.desc("n"), "lang").limit(languages).collect()]
    rows = (labelled.where(F.col(lang).cast("string").isin(names) & F.col(text).isNotNull())
            .select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"),
                    F.xxhash64(F.col(key).cast("string")).alias("h"), F.length(text).alias("n")))
    first = Window.partitionBy("lang").orderBy((F.col("n") < 400), "h", "key")
    picked = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).collect()
    chosen: dict[str, set] = {}
    got: dict[str, int] = {}
    for r in sorted(picked, key=lambda r: r["rank"]):
        if got.get(r["lang"], 0) < sample_chars:
            chosen.setdefault(r["lang"], set()).add(r["key"])
            got[r["lang"]] = got.get(r["lang"], 0) + r["n"]
    keys = set().union(*chosen.values()) if chosen else set()
    if not keys:
        return {}, sample_chars
    most_chars = min(sample_chars, total_chars // max(1, len(chosen)))
    found = (docs.where(F.col(key).isin(list(keys)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
             .select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"),
                     F.substring(text, 1, most_chars).alias("text"))
             .groupBy("key", "lang").agg(F.min("text").alias("text")).where(F.col("lang").isin(list(chosen))).collect())
    order = {(r["lang"], r["key"]): r["rank"] for r in picked}
    samples: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (order.get((r["lang"], r["key"]), 1 << 40), r["text"])):
        if r["key"] in chosen.get(r["lang"], ()):
            samples.setdefault(r["lang"], []).append(r["text"])
    return samples, most_chars


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, lang_pred and score of every row; columns named in ``keep`` are passed through.

    The model is broadcast; ``total_chars`` bounds its size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(keep))]

    @tidy
    def run(batches):
        model = shared.value
        for batch in batches:
            texts, size, start = batch.column(1), 0, 0
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for at in range(batch.num_rows + 1):
                if at == batch.num_rows or size > TOGETHER:
                    if at > start:
                        got = model.predict([t or "" for t in texts.slice(start, at - start).to_pylist()])
                        part = batch.slice(start, at - start)
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0), pa.array([g[0] for g in got], pa.string()),
                             pa.array([g[1] for g in got], pa.float64()), *part.columns[2:]],
                            ["key", "lang_pred", "score", *names])
                    start, size = at, 0
                if at < batch.num_rows:
                    size += lengths[at]

    columns = [F.col(key).alias("key"), F.col(text).alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]]
    more = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True))
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(*columns).mapInArrow(run, f"key {kind}, lang_pred string, score double{more}")
    return out.select(F.col("key").alias(key), "lang_pred", "score",
                      *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)])
