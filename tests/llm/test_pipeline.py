import os
import random

import corpus_pipeline as c
import pytest
import test_line_dedup
import test_near_dup
import test_packing
import test_quality_rules
import test_suffix_dedup

from tessera.llm import quality_rules, suffix_dedup


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common, passage, base = prose(9), prose(60), prose(120)
    texts = [None, "", "too short", "word " * 60]
    for _ in range(70):
        text = "\n".join([prose(rng.randint(10, 60)), *([common] if rng.random() < 0.3 else []), *([common + "x"] if rng.random() < 0.2 else []), prose(20)])
        texts.append(text + (" " + passage if rng.random() < 0.3 else ""))
    texts += [" ".join(w + "#$%" for w in prose(50).split()) for _ in range(30)]
    texts += [" ".join(w if rng.random() > 0.01 else "zz" for w in base.split()) for _ in range(10)] + texts[8:12]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0 if "#" in (t or "") else 1, 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outs = []
    for k, (_, stage) in enumerate(c.STAGES):
        before = sorted(docs.collect(), key=lambda r: r.doc_id)
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append((before, docs))
    after = lambda k: {r.doc_id: r.text for r in outs[k][1].collect()}

    before = outs[0][0]
    model = quality_rules.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    want = {}
    for r in before:
        n, chars, symbols, dup, rep = test_quality_rules.brute(r.text)
        import numpy as np

        x = np.array([[n, chars / max(n, 1), symbols / max(chars, 1), dup, rep / max(n, 1)]])
        if n >= 20 and 100 * rep <= 30 * n and not any(rule.mask(x)[0] for rule in model.rules):
            want[r.doc_id] = r.text
    assert model.rules and after(0) == want and not any("#" in t for t in want.values()) and len(want) > 70

    before = outs[1][0]
    gone = test_line_dedup.brute([(r.doc_id, r.text) for r in before])
    want = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[r.doc_id][0]) for r in before}
    assert after(1) == {d: t for d, t in want.items() if t.split()} and len(after(1)) < len(want)
    assert any(gone[d][0] for d in gone)

    before = outs[2][0]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    keep = {row[0] for row in test_near_dup.brute([(r.doc_id, texts[r.doc_id]) for r in before], 80) if row[3]}
    assert after(2) == {r.doc_id: r.text for r in before if r.doc_id in keep} and len(keep) < len(before)

    before = outs[3][0]
    changed = after(3)
    for r, (_, removed, _, sha) in zip(before, test_suffix_dedup.brute([r.text for r in before]), strict=True):
        left = changed.get(r.doc_id, "")
        assert len(r.text.encode()) - len(left.encode()) == removed and (r.doc_id in changed) == bool(left.split())
    assert any(changed.get(r.doc_id) != r.text for r in before)
    assert all(r.n_chars == len(r.text) for r in outs[3][1].collect())

    before = outs[4][0]
    ids = {r.doc_id: i for i, r in enumerate(before)}
    rows = [type("R", (), r.asDict() | {"doc_id": ids[r.doc_id]}) for r in outs[4][1].collect()]
    test_packing.check(rows, [r.text for r in before], 2048)


def test_near_copies_go_though_their_lines_went_before(spark, tmp_path):
    """Copies with a word of some lines changed: line dedup leaves only those lines, and the original texts decide."""
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(14))
    rows, families = [], 20
    for f in range(families):
        base = [line() for _ in range(12)]
        for k in range(4):
            edited = list(base)
            if k:
                i = rng.randrange(12)
                edited[i] = " ".join([*edited[i].split()[:-1], "changed" + str(rng.random())])
            rows.append((4 * f + k, "\n".join(edited), "en", "s", 0))
    path = str(tmp_path)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    left = c.materialize(c.lines(spark, df, path), "left")
    assert left.count() > families and left.where("length(text) < 300").count() > 0
    kept = c.near_duplicates(spark, left, path)
    assert sorted(r.doc_id for r in kept.collect()) == [4 * f for f in range(families)] and kept.columns == df.columns


def test_one_row_stays_of_repeated_and_null_ids(spark, tmp_path):
    text, other = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, text), (1, text), (1, text + " "), (2, text), (None, other), (None, other), (3, ""), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, c.near_dup.keep_one(df, 80).collect()), key=str)
    assert len([r for r in got if r[1] and r[1].strip() == text]) == 1 and got.count((None, other)) == 1
    assert {r[0] for r in got} == {1, None, 3, 4}


def test_run_packs_what_the_stages_keep(spark, sf):
    from tessera.llm.common import _folder

    folder = _folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert c.run(spark, sf).count() > 0
    # Only what the lazy result still reads is left: the last stage's documents and the pieces.
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before) == ["pieces", "suffix-array-dedup"]
    assert suffix_dedup.SPAN == 200 and [n for n, _ in c.STAGES][0] == "quality rules"
