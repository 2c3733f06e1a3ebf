import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.util import docs
from wardstat.llm.bpe import PRETOKENS, encoder
from wardstat.llm.chunk_bpe import (assemble, chunk_rows, decoded, encode_chunk, encode_documents)

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def want(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def odd_texts():
    rng = random.Random(3)
    parts = ["they'll", "I've", "don't", " 'll", "'", "  ", "\n", "\n\n", " \t ", "été", "ß", "123",
             "½", "!!!", "--", "日本", "😀", "<|endoftext|>", "\x1c", " ", " ", "Word",
             "word", "x" * 70, "ǅ", "\x00", "l", "ve", "s", "é"]
    out = [None, "", " ", "'l", "<|endoftext|>", "a<|endoftext|>b"]
    out += ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(300)]
    return out


def test_encoder_equals_library(library):
    enc = encoder(PATH)
    assert enc.fast
    for t in odd_texts():
        ids = enc.ids(t or "")
        assert ids == want(library, t), repr(t)
        assert enc.text(ids) == (t or "")


def test_real_texts_equal_library(spark, library):
    enc = encoder(PATH)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert enc.ids(r["text"]) == want(library, r["text"])


def test_joins_are_repaired_at_any_cut(library):
    """Chunks cut at every kind of place agree with the whole text."""
    enc, rng = encoder(PATH), random.Random(9)
    parts = ["they'll ", "don't", "  ", "\n", "été ", "12 34", "!!! ", "word ", "longerword", " '",
             "l", "ve", "s ", " x"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randrange(5, 200)))
        cuts = sorted({0, len(text), *rng.choices(range(len(text) + 1), k=rng.randrange(1, 6))})
        shared = []
        for a, b in zip(cuts, cuts[1:]):
            ids, stable, size = encode_chunk(enc, text[a:b])
            if stable and rng.random() < 0.7:
                shared.append((a, ids, stable))
        assert assemble(enc, text, shared) == want(library, text)


def test_chunks_cover_the_text_and_shared_passages_meet():
    rng = random.Random(1)
    passage = " ".join(f"é{rng.randrange(10**6)}" for _ in range(3000))
    seen = []
    for k in range(3):
        text = "x" * rng.randrange(2000) + passage + "y" * rng.randrange(2000)
        rows = list(chunk_rows(text))
        assert "".join(text[a:a + n] for a, n, _ in rows) == text
        seen.append({h for _, _, h in rows})
    assert len(seen[0] & seen[1] & seen[2]) > 12
    assert list(chunk_rows("")) == []


def test_whole_operator(spark, library):
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randrange(3000)}'s" for _ in range(2000))
    texts = odd_texts()[:60] + [passage, passage, "a" + passage, passage[7:] + " end",
                                passage * 10, "z" * 100_000]
    rows = list(enumerate(texts)) + [(None, passage), (None, None), (3, texts[3])]
    got = encode_documents(docs(spark, rows, extra=True), PATH)
    pairs = sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got.collect())
    assert pairs == sorted((str(i), want(library, t)) for i, t in rows)
    back = sorted(r["s"] for r in got.select(decoded(got["ids"], PATH).alias("s")).collect())
    assert back == sorted(t or "" for _, t in rows)
    same = encode_documents(docs(spark, rows), PATH, decode=True)
    assert sorted(r["decoded"] for r in same.collect()) == back
    assert encode_documents(docs(spark, [(1, "a")]).where("false"), PATH).count() == 0


def test_pretokens_cover():
    for t in odd_texts():
        assert "".join(PRETOKENS.findall(t or "")) == (t or "")
