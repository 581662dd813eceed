import itertools
import random
import re

import numpy as np
import pytest
from tessera.llm import near_dup as n
from tessera.llm.components import connected_components
from tessera.llm.shingles import shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    sets = [(i, brute_set(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (x, (i, a)), (y, (j, b)) in itertools.combinations(enumerate(sets), 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(y)] = find(x)
    low = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            low[find(x)] = min(low.get(find(x), i), i)
    return sorted(((i, len(s), None if i is None else low[find(x)], i is None or i == low[find(x)]) for x, (i, s) in enumerate(sets)), key=str)


def mutated(rng, words, share):
    return [w if rng.random() > share else f"m{rng.randint(0, 10**6)}" for w in words]


def corpus(rng, families=12, copies=12):
    texts = [None, "", " \n", "one", "one", "a b c d e", "A B c d E", "a b c d", "a\x0bb\x1cc d", "É é"]
    for _ in range(families):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([6, 20, 60, 200, 400]))]
        texts.append(" ".join(base))
        for _ in range(copies):
            texts.append(" ".join(mutated(rng, base, rng.choice([0, 0.003, 0.01, 0.02, 0.03]))))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_matches_brute_force(spark):
    rows = corpus(random.Random(11)) + [(None, "w1 w2 w3 w4 w5 w6"), (None, "w1 w2 w3 w4 w5 w6")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, n_shingles int, kept boolean")
    assert sorted(map(tuple, n.near_duplicates(df).collect()), key=str) == brute(rows)


def test_large_keys_and_groups_are_dealt_without_loss(spark, monkeypatch):
    monkeypatch.setattr(n.groups, "UNIT", 6)
    monkeypatch.setattr(n.groups, "HUBS", 2)
    rows = corpus(random.Random(5), families=4, copies=30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, n.near_duplicates(df).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert n.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_pair_within_the_threshold_meets():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (300, 64)).astype(np.uint16)
    b = a.copy()
    for r in range(len(a)):
        b[r, rng.choice(64, n.ERRORS, replace=False)] ^= 1
    ka, kb = n.index_keys(a, n.ERRORS, n.CHUNKS), n.index_keys(b, n.ERRORS, n.CHUNKS)
    assert all((ka[r] == kb[r]).any() for r in range(len(a)))


def test_signature_distance_follows_similarity():
    rng = np.random.default_rng(3)
    distances = []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        a, b = np.unique(x[:1850]), np.unique(x[150:])
        distances.append((n.signature(a) != n.signature(b)).sum())
    s = 1700 / 2000
    assert abs(np.mean(distances) - 64 * (1 - s)) < 0.8 and max(distances) <= n.ERRORS
    assert np.std(distances) < 3.4


@pytest.mark.parametrize("size", [2, 9, 40])
def test_forest_joins_what_lies_within(size):
    rng = np.random.default_rng(size)
    sig = rng.integers(0, 3, (size, 8)).astype(np.uint16)
    near = (sig[:, None] != sig[None]).sum(2) <= 3
    reach = np.linalg.matrix_power(near.astype(float), size) > 0
    label = np.arange(size)
    for a, b in n.forest(sig, np.full(size, 9), 3, 85):
        label[label == label[b]] = label[a]
    assert ((label[:, None] == label[None]) == reach).all()


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)] + [(500 + i, 500 + (7 * i) % 31) for i in range(31)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[202] == 200 and 300 not in got


def test_shingles():
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("a b")) == 1 and not len(shingle_set(" \n"))
    assert (shingle_set("A b c d e") == shingle_set("a B\tc\nd e ")).all()
    assert shingle_set("a b c d e")[0] != shingle_set("b a c d e")[0]


def test_links_of_asked_sets_and_of_those_that_share_enough():
    rng = np.random.default_rng(7)
    for percent in (50, 80, 100) * 8:
        base = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 90)), dtype=np.uint64))
        sets = [np.unique(np.append(base[rng.random(len(base)) > rng.choice([0, 0.03, 0.1, 0.2])], rng.integers(0, 1 << 62, rng.integers(1, 9), dtype=np.uint64))) for _ in range(40)]
        known = [int(x) if x < 3 else None for x in rng.integers(0, 20, 40)]
        asked = (rng.random(40) < 0.4).tolist()
        alike = {(j, i) for i in range(40) for j in range(i) if (asked[i] or asked[j]) and 100 * len(both := set(sets[i].tolist()) & set(sets[j].tolist())) >= percent * (len(sets[i]) + len(sets[j]) - len(both))}
        got = n.links(sets, percent, known, asked)
        assert {(min(p), max(p)) for p in got} <= alike
        one, other = n.groups.Classes(known), n.groups.Classes(known)
        for classes, pairs in ((one, got), (other, alike)):
            for i, j in pairs:
                classes.join(i, j)
        assert all((one.find(i) == one.find(j)) == (other.find(i) == other.find(j)) for i in range(40) for j in range(i))


def test_keys_and_shares_of_a_large_group_are_dealt_out_in_rounds(spark, monkeypatch):
    tables, dealt = [], []
    compared, written = n.groups._compared, n.materialize
    monkeypatch.setattr(n.groups, "_compared", lambda rows, *a: dealt.append(rows.count()) or compared(rows, *a))
    rows = spark.range(80).selectExpr("1L AS group", "id AS node", "8388608 AS weight", "id % 37 AS v")

    def of_unit(t):
        x, v, asked = t["node"].to_pylist(), t["v"].to_pylist(), t["asked"].to_pylist()
        return [(x[i], x[j]) for i in range(len(t)) for j in range(i) if v[i] == v[j] and (asked[i] or asked[j])]

    got = connected_components(n.groups.linked(rows, of_unit)).collect()
    assert sorted((r.node, r.component) for r in got if r.node != r.component) == [(i, i % 37) for i in range(37, 80)]
    assert max(dealt) < 4 * 80  # some 1,500 at once before
    texts = corpus(random.Random(13), families=3)
    want = brute(texts)
    monkeypatch.setattr(n, "ROUND_KEYS", 1)
    monkeypatch.setattr(n, "materialize", lambda df, tag: tables.append(tag) or written(df, tag))
    assert sorted(map(tuple, n.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()), key=str) == want
    assert tables.count("alike") > 1
