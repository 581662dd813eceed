import numpy as np
from tessera.llm import cross_polytope as c
from tessera.llm.common import table


def brute(rows, k, is_query):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, q in good:
        if is_query(i):
            scores = {(j, len(v)): float((q * v).sum()) for j, v in good if j != i and len(v) == len(q)}
            out[i] = [(j, s) for (j, _), s in sorted(scores.items(), key=lambda x: (-x[1], x[0][0]))[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 64)).astype(np.float32)
    y = c.rotate(x, c.signs(64, 0, 0))
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1), rtol=1e-4)


def test_probes_of_two_parts_start_at_the_own_bucket():
    x = np.random.default_rng(0).standard_normal((7, 20))
    assert (c.probes(x, 3, 2, 1) == c.probes(x, 3, 2, 9)[:, :1]).all()
    assert all(len(set(r)) == 9 for r in c.probes(x, 3, 2, 9))


def test_recall_against_brute_force(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = answers(c.search(rows.where("vec_id % 20 = 0"), rows))
    want = brute([(r.vec_id, r.embedding) for r in rows.collect()], 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    assert all(len(got[q]) == len(want[q]) for q in want)


def test_edge_vectors_ties_and_few_rows(spark):
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 0.1]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (9, [-1.0, 0.0]), (20, [1.0, 0.0]), (60, [float("inf"), 0.0]), (80, [1e-200, 1e-200])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    got = answers(c.search(df.where("vec_id % 20 = 0"), df, k=20))
    assert [i for i, _ in got[20]] == [3, 1, 2, 80, 9] and got[20][1][1] == got[20][2][1] == 1.0
    assert 40 not in got and 60 not in got and len(got[80]) == 5
    assert c.search(df.limit(0), df.limit(0)).count() == 0


def recall(got, want):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    return hits / sum(map(len, want.values()))


def test_hot_vector_and_shards(spark, monkeypatch):
    monkeypatch.setattr(c, "SHARD_ROWS", 20)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    rows = [(i, [1.0] * 8) for i in range(200)] + [(200 + i, list(map(float, base + 0.01 * rng.standard_normal(8)))) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(c.search(df.where("vec_id % 20 = 0"), df))
    want = brute(rows, 20, lambda i: i % 20 == 0)
    assert [i for i, _ in got[40]] == [i for i in range(21) if i != 40][:20]
    assert got.keys() == want.keys() and recall(got, want) >= 0.9


def test_settings_keep_recall_with_few_candidates(spark):
    """Buckets of two and three axes, each with the probes that measuring asks for, compare far fewer than all."""
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in rows.collect()], 20, lambda i: i % 20 == 0)
    for setting, least in (((1, 12), 0.9), ((2, 700), 0.9), ((3, 12), 0.0)):
        got = answers(c.search(rows.where("vec_id % 20 = 0"), rows, setting=setting))
        assert recall(got, want) >= least and all(len(got[q]) == 20 for q in want), setting
    x = np.array([r.embedding for r in rows.collect()], float)
    share = lambda s: c.Index(x, [[i] for i in range(len(x))], s).candidates(x[::20]).mean()
    assert share((2, 700)) < 0.35 < share((1, 12)) < 0.55


def test_measured_setting_is_cheaper_among_closer_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((300, 32))
    x = np.repeat(centres, 30, 0) + 0.2 * rng.standard_normal((9000, 32))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    own, distinct = c.usable(rows.where("vec_id % 20 = 0"), "vec_id", "embedding"), c.usable(rows, "vec_id", "embedding").selectExpr("v", "dims", "array(id) AS ids")
    setting = c.tune(own, distinct, 20)[32]
    assert c.Index(x, [[i] for i in range(len(x))], setting).candidates(x[::20]).mean() < 0.1
    got = answers(c.search(rows.where("vec_id % 20 = 0"), rows))
    assert recall(got, brute(list(enumerate(x.tolist())), 20, lambda i: i % 20 == 0)) >= 0.9


def test_long_vectors_in_other_directions_are_found(spark):
    """Inner products of vectors of very different norms: the measurement asks for more buckets."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16)) * np.exp(2 * rng.standard_normal((600, 1)))
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(answers(c.search(df.where("vec_id % 20 = 0"), df)), brute(rows, 20, lambda i: i % 20 == 0)) >= 0.9
