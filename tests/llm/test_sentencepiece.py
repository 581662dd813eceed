import hashlib
import random

import pytest
from tessera.llm import sentencepiece_bpe as s
from tessera.llm.registry import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "▁", "é", "é", "中", "😀", "\x00", "\x1c", "　", "<s>", "<0x41>", "the", "ing", "▁the", "\r", "ﬁ", "�", "12"]


@pytest.fixture(scope="module")
def codec():
    return s.Codec(MODEL)


def test_same_as_library_on_random_texts(codec):
    rng = random.Random(7)
    for _ in range(3000):
        x = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        ids = codec.lib.encode(x)
        assert codec.encode(x) == ids, x
        assert codec.decode(ids) == codec.lib.decode(ids), x
    assert not codec.mismatches


def test_heap_and_list_agendas_agree(codec):
    rng = random.Random(1)
    for _ in range(500):
        u = "▁" + "".join(rng.choice("theinrgsaouédl.") for _ in range(rng.randint(1, 90)))
        assert codec._short(list(u)) == codec._long(list(u))


def test_cache_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(s, "CACHE_UNITS", 5)
    c = s.Codec(MODEL)
    for i in range(40):
        assert c.encode(f"word{i} and word{i + 1}\n") == c.lib.encode(f"word{i} and word{i + 1}\n")
        assert len(c.cache) <= 5 + 5


def test_digests(spark, codec):
    texts = [None, "", "a", " b  c\n", "the thing " * 20000, "x" * 3000, "a"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in s.digests(df, MODEL).collect()}
    for i, t in enumerate(texts):
        ids = codec.lib.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(codec.lib.decode(ids).encode()).hexdigest()
    rows = {r.doc_id: r for r in s.encode_documents(df, MODEL).collect()}
    assert rows[3].ids == codec.lib.encode(texts[3]) and rows[3].decoded == texts[3]


def test_empty_table(spark):
    assert s.digests(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_mismatches_are_told(spark, codec, monkeypatch):
    c = s.Codec(MODEL)
    monkeypatch.setattr(c, "merge", lambda unit: [5] if unit == "▁odd" else codec.merge(unit))
    assert c.encode("odd one") == c.lib.encode("odd one") and c.mismatches == {" odd"}
    df = spark.createDataFrame([(1, "the odd thing")], "doc_id long, text string")
    assert s.digests(df, MODEL).first().mismatches == 0
