"""Plain single-process versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def groups(rows, n, percent):
    """[(doc_id, n_shingles, component_id)] by comparing every two documents that share a shingle."""
    sets = [shingle_set(t, n) for _, t in rows]
    at = defaultdict(list)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in at[x])
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[root(i)] = root(j)
        for x in s:
            at[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def pii(text):
    """Base spans as kind:start:end."""
    text, out = text or "", []

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    for kind, pattern, good in rules:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if good(m.group())]
    return out


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text or ""))
    starts, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def bpe(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False):
        decoded = t.decode(e.ids, skip_special_tokens=False)
        out.append((len(e.ids), sha(" ".join(map(str, e.ids))), sha(decoded)))
    return out


def token_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids


def top_k(vectors, k):
    """[(query_id, rank, vec_id, score)] of int lists, by all pairs."""
    out = []
    for i, (q, a) in enumerate(vectors):
        if q % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), v) for j, (v, b) in enumerate(vectors) if j != i)
        out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scores[:k])]
    return sorted(out)


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


