import os
import random

import pytest

from wardline.llm import tokens
from wardline.llm.queries import TOKENIZERS

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", "Hello world", "<|endoftext|> and </s>", "  two  blanks \n\n\n", "a" * 9000, "日本語テキスト" * 1500, "été naïve ﬁ", "​﻿\x00\x1c", " \n\n" * 3000 + "q", "it's we'll" * 900, "Donaudampfschiff" * 700 + " end", "\n\n" + "x" * 5000 + "\n\n" * 2500 + "y" * 5000]


@pytest.mark.parametrize("piece", [tokens.PIECE, 700, 3])
def test_equals_other_implementation(spark, reference, piece):
    rows = [(i, t, "ids") for i, t in enumerate(TEXTS)] + [(100, None, ""), (None, "null id", ""), (1, "Hello world", "again")]
    got = tokens.encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), "doc_id", "text", RANKS, piece)
    assert dict(got.dtypes)["ids"] == "array<int>"
    have = sorted(((r.doc_id if r.doc_id is not None else -1), list(r.ids)) for r in got.collect())
    want = sorted(((-1 if i is None else i), reference(t) if t else []) for i, t, _ in rows)
    assert have == want


def test_pieces_join_exactly():
    coder = tokens.coder(open(RANKS, "rb").read())
    rng = random.Random(3)
    parts = ["ab" * 20, " ", "\n", "  \n", "'s", "'l", "9" * 30, "é日", "!", " x", "\t" * 9, "࢏\x1c", "aaaaa", "ing", "'", "\u3000", "\x85", "\x1d", "́" * 3, "😀", "²", "日本語の"]
    joined = 0
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(60))
        piece = rng.choice([1, 3, 7, 20])
        cuts = tokens.cut(text, piece)
        assert "".join(c if isinstance(c, str) else "".join(c) for c in cuts) == text
        joined += sum(not isinstance(c, str) for c in cuts)
        assert tokens.encode_text(text, coder, piece) == coder.encode_ordinary(text), text
    assert joined > 1000


def test_threads_change_nothing(monkeypatch):
    coder = tokens.coder(open(RANKS, "rb").read())
    text = ("Lorem " + "donaudampfschiff" * 40 + " 日本語" * 30) * 5
    monkeypatch.setattr(tokens, "MANY", 10)
    assert tokens.encode_text(text, coder) == coder.encode_ordinary(text)


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="needs the test tables")
def test_documents_have_joins(reference):
    """Texts of the corpus hold unsplit runs longer than a piece, and come out as by the other implementation."""
    import pyarrow.parquet as pq

    coder = tokens.coder(open(RANKS, "rb").read())
    texts = [t for t in pq.read_table(DOCUMENTS, columns=["text"])["text"].to_pylist() if t]
    joined = [t for t in texts if any(not isinstance(c, str) for c in tokens.cut(t))]
    assert len(joined) >= 5
    for t in joined:
        assert tokens.encode_text(t, coder) == reference(t)


def test_empty_table(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text", RANKS).count() == 0
