import collections
import math
import random
import zlib

import numpy as np
from tessera.llm import packing as p
from tessera.llm.registry import tokenizer_path
from tokenizers import Tokenizer

PATH = tokenizer_path("word_bpe_49k.json")


def check(rows, texts, capacity):
    lib = Tokenizer.from_file(PATH)
    want = {}
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[i, k // capacity] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), math.ceil(sum(r.length for r in rows) / capacity)


def test_documents_round_trip_and_gapless(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "a", "It's 12 o'clock, don't\tgo\x1cnow", "é é É", "<|endoftext|> x<|startoftext|>y", "ΑΣ Σ σΣ.", "　中文 text\xa0b c", "the cat " * 900, "x" * 5000, "a", "\x00 \x85 ﬁ", "a\x01 \x01 b\x01c \x01\x01", "Word. word, WORD,. É. é, x1. İ. ABC<|ENDOFTEXT|> <|endoftext|>. ſ. 'S it'S."]
    texts += [" ".join(rng.choice(["the", "Ünd", "thatis", "1,2", "\n", "", "'s"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    n, bound = check(p.pack_documents(df, PATH, capacity=64).collect(), texts, 64)
    assert n <= bound * 1.03 + 1


def test_plan_covers_exactly_and_is_near_the_volume_bound():
    rng = np.random.default_rng(5)
    for size in (1, 7, 300, 20000):
        h = collections.Counter(int(x) for x in np.clip(rng.lognormal(5.5, 1.2, size), 1, 2048))
        bins = p.plan(dict(h))
        got = collections.Counter()
        for config, times in bins:
            assert sum(config) <= 2048 and times > 0
            for x in config:
                got[x] += times
        assert got == h
        assert sum(t for _, t in bins) <= math.ceil(sum(k * v for k, v in h.items()) / 2048) * 1.01 + 1


def arrays(h, times=1):
    lengths = np.array(sorted(h))
    return lengths, np.array([h[int(x)] * times for x in lengths])


def test_configurations_place_nearly_all():
    rng = np.random.default_rng(6)
    h = collections.Counter(int(x) for x in np.clip(rng.lognormal(6.2, 1.0, 11000), 1, 2048))
    for times in (1, 300):
        lengths, counts = arrays(h, times)
        found, bound = p.configurations(lengths, counts, 2048)
        assert bound >= (lengths * counts).sum() / 2048 - 1e-6
        got = collections.Counter()
        for config, n in found:
            assert sum(config) <= 2048 and n > 0
            for x in config:
                got[x] += n
        assert all(got[int(x)] <= n for x, n in zip(lengths, counts, strict=True))
        assert sum(got.values()) >= 0.95 * counts.sum(), (times, sum(got.values()) / counts.sum())
        assert sum(x * n for x, n in got.items()) >= 0.9 * (lengths * counts).sum()
    bins = p.plan({int(x): int(n) for x, n in zip(lengths, counts, strict=True)})
    assert sum(n for _, n in bins) <= math.ceil((lengths * counts).sum() / 2048) * 1.01 + 1


def test_fractional_solution_covers_within_its_gap_of_a_true_bound():
    rng = np.random.default_rng(7)
    for lengths, counts in (([1100, 1500], [5, 2]), ([700], [9]), ([341, 681, 682, 683, 684, 1024, 1025], [2800] * 7), (sorted(rng.choice(2048, 60, replace=False) + 1), rng.integers(1, 90, 60))):
        lengths, counts = np.array(lengths), np.array(counts)
        for gap in (0.3, 0.1):
            bins, bound = p.fractional(lengths, counts, 2048, gap)
            cover = np.zeros(len(lengths))
            for config, x in bins.items():
                assert sum(lengths[j] * often for j, often in config) <= 2048
                for j, often in config:
                    cover[j] += x * often
            assert (cover >= counts * (1 - 1e-9)).all()
            assert bound <= sum(bins.values()) * (1 + 1e-9) <= (1 + gap) * bound * (1 + 1e-6)
            assert bound <= sum(t for _, t in p.plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), gap=gap)) + 1e-6


def test_lengths_that_only_fit_in_few_ways():
    # Best fit by decreasing length needs 7,387 bins here, the volume alone 7,129.
    h = collections.Counter(np.random.default_rng(0).choice([341, 681, 682, 683, 684, 1024, 1025], 20000).tolist())
    assert sum(t for _, t in p.plan(h)) <= 7200


def test_program_places_the_pieces_of_the_documents(spark):
    import os

    base = "/root/testdata/sf0.1"
    if not os.path.isdir(base):
        return
    rows = p.pieces(spark.read.parquet(f"{base}/documents.parquet"), PATH).groupBy("length").count().collect()
    lengths, counts = arrays({r["length"]: r["count"] for r in rows})
    found, bound = p.configurations(lengths, counts, 2048)
    assert sum(len(config) * n for config, n in found) >= 0.98 * counts.sum()
    bins = sum(n for _, n in p.plan({int(x): int(n) for x, n in zip(lengths, counts, strict=True)}))
    assert bound <= bins <= 1.005 * bound + 1


def test_plan_of_large_items_only():
    bins = p.plan({1100: 5, 1500: 2})
    assert sum(t for _, t in bins) == 7
    assert p.plan({}) == []


def test_hot_length_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(p, "RANK_ROWS", 10)
    texts = ["same words here"] * 150 + ["other"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(p.pack_documents(df, PATH, capacity=32).collect(), texts, 32)


def test_empty_table(spark):
    assert p.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
