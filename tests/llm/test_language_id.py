import random

import numpy as np
from tessera.llm import language_id as g
from tessera.llm.common import table


def test_windows_cover_every_byte_and_every_gram():
    for n in (0, 1, 3, 4, 252, 253, 254, 256, 257, 1000, 5003):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        x = g.windows(data)
        assert x.shape[1] == g.WINDOW
        grams = {bytes(r[i : i + 4].astype(np.uint8)) for r in x for i in range(g.WINDOW - 3) if (r[i : i + 4] != g.PAD).all()}
        assert grams == {data[i : i + 4] for i in range(n - 3)}


def test_gradient_learns_two_alphabets():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(97, 105, (200, 64)), rng.integers(101, 115, (200, 64))]).astype(np.uint16)
    y = np.repeat([0, 1], 200)
    net = g.train(x, y, ["a", "b"], epochs=3)
    assert (net.probabilities(x).argmax(1) == y).mean() > 0.98


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    net = g.fit(docs)
    rows = g.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(own) > 200
    assert sum(own) / len(own) > 0.97, sum(own) / len(own)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows(spark):
    import zlib

    texts = [None, "", "123 !?\n", "the and of that " * 30, "der die und nicht " * 30, "the and of that " * 30, "the and of " * 20000]
    langs = ["en", "en", None, "en", "de", "en", None]
    rows = [(i, t, lang, "y", 1) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))] + [(None, "the and", "en", "y", 1)]
    rows += [(100 + i, "the of and that is was for " * 20 if i % 2 else "der die und nicht ein ist das " * 20, "en" if i % 2 else "de", "y", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, held_out int")
    net = g.fit(df)
    got = {r.doc_id: r for r in g.predict(df, net).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["und", "und", "und", "en", "de", "en", "en"]
    assert got[3].score == got[5].score and got[0].score == 0
    assert not got[None].held_out
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(7))
    assert g.fit(df.where("lang is null")) is None
    assert {r.lang_pred for r in g.predict(df, None).collect()} == {"und"}
    assert g.predict(df.limit(0), net).count() == 0


def plain(net, data):
    """Filters, maxima and softmax written out, over the windows that start every WINDOW - 3 bytes; weighted by bytes."""
    total, starts = np.zeros(len(net.languages)), range(0, max(1, len(data) - 3), g.WINDOW - 3)
    for start in starts:
        x = [*data[start : start + g.WINDOW]]
        n = len(x)
        x += [g.PAD] * (g.WINDOW - n)
        pooled = []
        for w, r in zip(g.WIDTHS, net.responses, strict=True):
            for f in range(g.FILTERS):
                pooled.append(max(sum(float(r[j, x[i + j], f]) for j in range(w)) for i in range(g.WINDOW - w + 1)))
        h = [max(0.0, p + float(b)) for p, b in zip(pooled, net.bias, strict=True)]
        z = [sum(a * float(b) for a, b in zip(h, net.weight[:, k], strict=True)) + float(net.offset[k]) for k in range(len(net.languages))]
        e = [np.exp(v - max(z)) for v in z]
        total += n * np.array([v / sum(e) for v in e])
    return total / total.sum()


def test_prediction_is_the_plain_convolution(spark):
    rng = random.Random(5)
    net = g.Network.new(["", "aa", "und"], seed=3)
    texts = ["a", "éa", "x" * 256, "".join(rng.choice("abc dé中") for _ in range(700)), "".join(rng.choice("abc d") for _ in range(253)), "".join(rng.choice("abc d") for _ in range(257))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in g.predict(df, net).collect()}
    for i, t in enumerate(texts):
        p = plain(net, t.encode())
        assert abs(got[i].score - p.max()) < 1e-4 and (got[i].lang_pred == net.languages[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-4), i


def test_labels_of_any_name_and_multi_byte_pieces(spark):
    rng = random.Random(6)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    kinds = {"": "ağşıb ", "und": "中文字a ", "xx": "qwzyk "}
    rows = [(10 * k + j, make(kinds[lang], 900), lang) for k in range(60) for j, lang in enumerate(kinds)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = g.fit(df)
    assert net.languages == ["", "und", "xx"]
    held = [r for r in g.predict(df, net).join(df.select("doc_id", "lang"), "doc_id").collect() if r.held_out]
    assert len(held) > 20 and all(r.lang == r.lang_pred for r in held)
