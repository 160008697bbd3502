"""BPE encoding and decoding with a contiguous rank array per word.

A word is held as a list of parts and a parallel list with the merge rank of each part and its
right neighbour. The smallest rank is looked for by a scan, the boundary behind it is deleted and
the two neighbouring ranks are refreshed, until no neighbours merge. A scan is the fastest way for
short words; words beyond ``SHORT`` parts take the same merges from a heap, so that one very long
word costs n log n instead of n squared. Letters and digits are those that the vocabulary's library knows.

Defined results: null text encodes as the empty text, which has no ids and decodes to the empty
string; repeated rows each get their own result; extra columns are left out of the result.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlatlas.llm.common import CHUNK, Bounded, sha256_hex

SHORT = 96
MEMO = 300_000
LATER = regex.compile(r"[\p{L}\p{N}]")
# str.split() parts text at these too, which the pattern takes for signs.
SEPARATORS = re.compile("[\x1c-\x1f]")
NO_MERGE = 1 << 60


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class RankArrayBPE:
    """Encoder and decoder for a tokenizer file of lower-cased words with a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.symbols = byte_symbols()
        self.inner = [self.vocab[c] for c in self.symbols]
        self.last = [self.vocab[c + self.suffix] for c in self.symbols]
        self.ranks: dict[int, int] = {}  # by left id << 20 | right id
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            self.ranks.setdefault(self.vocab[left] << 20 | self.vocab[right], rank)
            self.merged.append(self.vocab[left + right])
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(self._known(pattern, path))
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memo = Bounded(self._shown, MEMO)

    def _known(self, pattern: str, path: str) -> str:
        """The pattern with letters and digits as the vocabulary's library knows them.

        The matcher, the interpreter and the library have tables of different Unicode versions. The library is
        asked about each letter and digit that is newer than the interpreter: whether it takes it for a sign,
        and what it makes of it in lower case.
        """
        library = Tokenizer.from_file(path)
        pieces, normal = library.pre_tokenizer.pre_tokenize_str, library.normalizer.normalize_str
        later = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000
                 and unicodedata.category(chr(c)) == "Cn" and LATER.match(chr(c))]
        self.later_lower = {ord(c): normal(c) for c in later if normal(c) != c}
        self.cased = re.compile("[" + "".join(map(re.escape, map(chr, self.later_lower))) + "]") if self.later_lower else None
        # A sign stays in one piece with a sign before it.
        signs = [ord(c) for c in later if len(pieces("!" + c)) == 1]
        runs: list[list[int]] = []
        for c in signs:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        text = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in runs)
        if not text:
            return pattern
        return "(?V1)" + (pattern.replace(r"[\p{L}]", rf"[\p{{L}}--[{text}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{text}]]")
                .replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{text}])"))

    def normal(self, text: str) -> str:
        """NFC, then lower case by code point (without the context that a final sigma has)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        if self.cased is not None and self.cased.search(text):
            text = text.translate(self.later_lower)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def merge_word(self, word: str) -> list[int]:
        data = word.encode()
        parts = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        return self._by_scan(parts) if len(parts) <= SHORT else self._by_heap(parts)

    def _by_scan(self, parts: list[int]) -> list[int]:
        rank_of, merged = self.ranks.get, self.merged
        ranks = [rank_of(a << 20 | b, NO_MERGE) for a, b in pairwise(parts)]
        while ranks:
            least = min(ranks)
            if least == NO_MERGE:
                break
            at = ranks.index(least)
            new = parts[at] = merged[least]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(new << 20 | parts[at + 1], NO_MERGE)
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << 20 | new, NO_MERGE)
        return parts

    def _by_heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank_of = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at]
            if not alive[at] or right >= n or rank_of(parts[at] << 20 | parts[right]) != rank:
                continue
            parts[at], alive[right], after[at] = self.merged[rank], False, after[right]
            if after[at] < n:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < n:
                    new = rank_of(parts[left] << 20 | parts[after[left]])
                    if new is not None:
                        heapq.heappush(heap, (new, left))
        return [p for p, a in zip(parts, alive, strict=True) if a]

    def _shown(self, run: str) -> tuple[str, str, int]:
        """Ids, tokens and their number for a run without white space."""
        if run.isalpha():
            words = [run]
        elif run[:-1].isalpha() and run[-1] in ".,":
            words = [run[:-1], run[-1]]
        else:
            words = self.words.findall(run)
        ids = [i for word in words for i in self.merge_word(word)]
        return " ".join(map(str, ids)), self.decode(ids), len(ids)

    def _runs(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """Special tokens (True) and runs between white space (False), in order. No match holds
        white space, so runs can be looked up one by one."""
        parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield True, [part]
            elif part:
                part = self.normal(part)
                yield False, self.words.findall(part) if SEPARATORS.search(part) else part.split()

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_shown(text)[0].split()]

    def encode_shown(self, text: str) -> tuple[str, str, int]:
        """Ids and tokens, each joined by spaces, and their number."""
        got: list[tuple[str, str, int]] = []
        for special, runs in self._runs(text):
            got += [(str(self.special[r]), r, 1) for r in runs] if special else map(self.memo.__getitem__, runs)
        if not got:
            return "", "", 0
        ids, tokens, counts = zip(*got, strict=True)  # every run gives at least one id
        return " ".join(ids), " ".join(tokens), sum(counts)

    def decode(self, ids) -> str:
        """Tokens joined by spaces: what a file without a decoder asks for."""
        return " ".join(self.tokens[i] for i in ids)


_LOADED: dict[str, RankArrayBPE] = {}


def tokenizer(path: str) -> RankArrayBPE:
    """One tokenizer per worker and file."""
    if path not in _LOADED:
        _LOADED[path] = RankArrayBPE(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array<int>) and decoded (string) of every row."""

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), CHUNK):
                ids = [bpe.encode(t or "") for t in texts[at:at + CHUNK]]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, CHUNK), pa.array(ids, pa.list_(pa.int32())),
                     pa.array([bpe.decode(i) for i in ids], pa.string())], ["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, and SHA-256 of the ids and of the decoded text, without building id columns."""

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), CHUNK):
                got = [bpe.encode_shown(t or "") for t in texts.slice(at, CHUNK).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, CHUNK), pa.array([n for _, _, n in got], pa.int64()),
                     pa.array([sha256_hex(i.encode()) for i, _, _ in got], pa.string()),
                     pa.array([sha256_hex(d.encode()) for _, d, _ in got], pa.string())],
                    ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
