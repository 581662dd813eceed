import random
import re

import numpy as np

from tessera.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics_match_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a b c d e f g", "x y z " * 9, "a\n\na\nb \na", "é#| b\x0bc\x1cd", "w " * 400, "\n".join(["one two"] * 5)]
    texts += ["".join(rng.choice(["a", "bb", "ccc", " ", " ", "\n", "\t", "#", "é"]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    texts += [" ".join(f"w{rng.randint(0, 2)}" for _ in range(rng.randint(0, 80))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in q.judge(df.select("doc_id", "text"), q.DecisionList()).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep = brute(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), t
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert r.kept == (not r.base_failed)


def test_learn_finds_the_planted_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(q.FEATURES)))
    bad = (x[:, 2] >= 0.8) & (x[:, 4] >= 0.5)
    model = q.learn(x, bad)
    hit = np.any([r.mask(x) for r in model.rules], axis=0)
    assert (hit & bad).sum() / bad.sum() > 0.95 and (hit & ~bad).sum() / hit.sum() < 0.05


def test_no_labels_keep_all(spark):
    docs = spark.createDataFrame([(1, "word " * 5 + " ".join(f"u{i}" for i in range(40))), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = q.fit(docs, labels)
    assert not model.rules
    assert [r.doc_id for r in q.filter_documents(docs, model).collect()] == [1]


def test_filter_keeps_clashing_columns(spark):
    text = " ".join(f"u{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "a", 5)], "doc_id long, text string, kept string, n_words int")
    assert q.filter_documents(docs, q.DecisionList()).collect()[0].asDict() == {"doc_id": 1, "text": text, "kept": "a", "n_words": 5}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert q.judge(docs, q.DecisionList()).count() == 0


def test_learned_rules_reject_junk(spark):
    from tessera.llm.common import table

    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = q.fit(docs, labels)
    assert model.rules
    rows = {r.quality: r for r in q.judge(docs.select("doc_id", "text"), model).join(labels, "doc_id").selectExpr("quality", "int(kept) k").groupBy("quality").avg("k").collect()}
    assert rows[1]["avg(k)"] > 0.95 and rows[0]["avg(k)"] < 0.2, rows
