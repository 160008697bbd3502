"""Token ids of whole texts as the tokenizers library gives them.

Plain texts are encoded by the ranks of the same vocabulary, which is several times faster; texts
with other characters or with special tokens go to the library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from crawlatlas.llm.bpe import byte_symbols

# In texts of these characters the two libraries agree on letters, digits and white space.
OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
# Fixed value: the pattern by which byte-level vocabularies cut text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of a byte-level tokenizer file, as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        # Ids follow the order of the merges, so they serve as ranks.
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.ranked = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def by_library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit numbers."""
        if OTHER.search(text) or any(s in text for s in self.special):
            return self.by_library(text)
        return np.array(self.ranked.encode_ordinary(text), "<u4")


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
