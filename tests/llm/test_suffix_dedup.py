import collections
import hashlib
import random

import numpy as np
import pytest
from tessera.llm import anchors
from tessera.llm import suffix_dedup as d


def brute(texts, span=d.SPAN):
    """Bytes covered by a string of span bytes that starts twice or more."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + span] for t in data for i in range(len(t) - span + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(n))


def corpus(rng):
    passages = [prose(rng, 60), prose(rng, 45), prose(rng, 300), "x" * 199, "y" * 200, "z" * 201, "ab" * 150, "\x00\x01" * 120]
    texts = [None, "", "short", passages[3], passages[4], passages[5], "q" * 1000, "Orre " * 400]
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 60)) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts.insert(rng.randint(0, len(parts)), p[a:] if rng.random() < 0.5 else p[: len(p) - a])
        texts.append("".join(parts))
    texts += texts[20:24] + [prose(random.Random(1), 400), prose(random.Random(1), 400)[:-1] + "!"]
    base = prose(rng, 200).split(" ")
    for _ in range(25):
        texts.append(" ".join(w if rng.random() > 0.03 else "MUT" + str(rng.randint(0, 9)) for w in base))
    return texts


def check(spark, texts):
    df = spark.createDataFrame([(i if i != 7 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in d.digest(df).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i if i != 7 else None] == w, (i, (texts[i] or "")[:60], got[i if i != 7 else None], w)


def test_matches_brute_force(spark):
    check(spark, corpus(random.Random(3)))


def test_large_groups_are_halved_without_loss(spark, monkeypatch):
    monkeypatch.setattr(d, "UNIT", 5)
    check(spark, corpus(random.Random(8)))


def test_large_groups_go_by_slices(spark, monkeypatch):
    monkeypatch.setattr(d, "WINDOWS", 300)
    check(spark, corpus(random.Random(9)))


def test_empty_table_and_clean(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert d.digest(empty).count() == 0
    p = prose(random.Random(4), 80)
    df = spark.createDataFrame([(1, "one " + p, "s"), (2, p + " two", "s"), (3, None, "s"), (4, "é", "s")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in d.clean(df).collect()}
    assert (got[1].text, got[2].text, got[3].text, got[4].text) == ("one ", " two", None, "é") and got[1].spans == "s"


@pytest.mark.parametrize("seed", range(6))
def test_two_stage_sort_orders_suffixes(seed):
    rng = np.random.default_rng(seed)
    text = np.concatenate([rng.integers(0, [2, 3, 256][seed % 3], 600).astype(np.uint8), np.full(50, 5, np.uint8), rng.integers(0, 2, 300).astype(np.uint8), np.zeros(60, np.uint8)])
    wanted = np.sort(rng.choice(900, 400, replace=False))
    order = d.sort_suffixes(text, wanted, 40)
    assert sorted(order.tolist()) == wanted.tolist()
    raw = text.tobytes()
    cut = [raw[i : i + 40] for i in order]
    assert cut == sorted(cut)
    lcp = d.common_prefixes(text, order, 40)
    for k in range(1, len(order)):
        n = 0
        while n < 40 and cut[k][n : n + 1] == cut[k - 1][n : n + 1]:
            n += 1
        assert lcp[k] == n


def test_every_window_has_an_anchor_that_depends_on_it_alone():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 100, 230).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 100, int(n)).astype(np.uint8), shared, rng.integers(97, 100, int(m)).astype(np.uint8)]) for n, m in rng.integers(0, 300, (20, 2))]
    data = np.concatenate(texts)
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    at, _ = anchors.anchor_positions(data, start, end, 200)
    marks = []
    for t, s, e in zip(texts, start, end, strict=True):
        own = at[(at >= s) & (at + anchors.GRAM <= e)] - s
        for i in range(len(t) - 199):
            assert ((own >= i) & (own + anchors.GRAM <= i + 200)).any()
        one, _ = anchors.anchor_positions(t, np.array([0]), np.array([len(t)]), 200)
        assert (one == own).all()


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(anchors, "SEGMENT", 1000)
    t = np.random.default_rng(2).integers(97, 100, 9000).astype(np.uint8)
    a, ha = anchors.anchors_of(t, 200)
    b, hb = anchors.anchor_positions(t, np.array([0]), np.array([len(t)]), 200)
    assert (a == b).all() and (ha == hb).all()


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_each_window_belongs_to_its_leftmost_least_anchor(letters):
    t = np.random.default_rng(letters).integers(97, 97 + letters, 900).astype(np.uint8)
    t[300:500] = np.tile([97, 98, 99, 100], 50)
    h = anchors.gram_hashes(t)
    at, ha = anchors.anchor_positions(t, np.array([0]), np.array([len(t)]), 200)
    before, after = anchors.neighbours(at, ha, 136)
    owner = {}
    for p, b, a in zip(at.tolist(), before.tolist(), after.tolist(), strict=True):
        for w in range(max(0, p - 136, b + 1), min(p, len(t) - 200, a - 137) + 1):
            assert w not in owner
            owner[w] = p
    assert owner == {w: w + int(h[w : w + 137].argmin()) for w in range(len(t) - 199)}
