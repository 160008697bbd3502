"""Letters of later Unicode versions, and names that clash with those in use."""

import random
import sys
import unicodedata
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

from test_operators import WORDS, spark, table  # noqa: E402, F401

from crawlatlas.llm import bpe, pii  # noqa: E402


def test_letters_newer_than_the_interpreter():
    library, own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.RankArrayBPE(WORDS)
    later = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and bpe.LATER.match(chr(c))]
    r = random.Random(4)
    texts = [t for c in r.sample(later, 500) for t in (c, f"ab{c}c", f"!{c}?", f"1{c}2 {c}{c}")]
    texts += ["".join(r.choice([*"aB1 !", r.choice(later)]) for _ in range(12)) for _ in range(1500)]
    for text in texts:
        assert list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_redacted_rows_keep_columns_of_any_name(spark):  # noqa: F811
    docs = table(spark, [(1, "mail a@b.example now"), (1, "mail a@b.example now"), (2, None)], "doc_id long, text string", clash=False)
    names = ["_t1", "_t2", "_f1", "_f2", "_found", "found", "found_", "t1", "f1", "row", "kind"]
    docs = docs.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == [(1, "mail <EMAIL> now", *names)] * 2 + [(2, None, *names)]
