import collections
import hashlib

import numpy as np
import pytest
import sentencepiece
import test_cross_polytope
import test_language_id
import test_line_dedup
import test_near_dup
import test_packing
import test_quality_rules
import test_suffix_dedup
import test_url_rules
from oracle import compare, connect

from tessera.llm import language_id, line_dedup, quality_rules, url_rules
from tessera.llm.common import table
from tessera.llm.registry import ORACLE_SQL, QUERIES, tokenizer_path

BASE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, name):
    assert compare(spark, connect(BASE), QUERIES[name], ORACLE_SQL[name], BASE) > 0


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


# The registered queries over the whole tables of the smallest size, against brute force.


def test_op1(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    mined = url_rules.mine(pages, table(spark, sf_dir, "labels"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in QUERIES["op1_url_filters"](spark, sf_dir).collect()}
    assert got == {r.page_id: test_url_rules.brute_verdict(r.url, url_rules.RULES, mined) for r in pages.collect()}


def test_op2(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    want = test_cross_polytope.brute(rows, 20, lambda i: i % 20 == 0)
    got = test_cross_polytope.answers(QUERIES["op2_cross_polytope"](spark, sf_dir))
    vectors = {i: np.array(v, float) for i, v in rows if v}
    assert got.keys() == want.keys() and test_cross_polytope.recall(got, want) >= 0.9
    assert all(len(v) == 20 and all(abs(s - float(vectors[q] @ vectors[i])) < 1e-12 for i, s in v) and v == sorted(v, key=lambda x: (-x[1], x[0])) for q, v in got.items())


def test_op4(spark, sf_dir, texts):
    got = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, sf_dir).collect()}
    net = language_id.fit(table(spark, sf_dir, "documents"))
    assert got.keys() == texts.keys()
    for d in sorted(texts)[::9]:
        t = texts[d] or ""
        if not any(map(str.isalpha, t)):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
        elif len(t) < 3000:
            p = test_language_id.plain(net, t.encode())
            assert abs(got[d].score - p.max()) < 1e-3


def test_op5(spark, sf_dir, texts):
    order = sorted(texts)
    rows = [type("R", (), r.asDict() | {"doc_id": order.index(r.doc_id)}) for r in QUERIES["op5_packing"](spark, sf_dir).collect()]
    bins, bound = test_packing.check(rows, [texts[d] for d in order], 2048)
    assert bins <= 1.02 * bound + 1


def test_op6(spark, sf_dir, texts):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op6_suffix_array"](spark, sf_dir).collect()}
    order = sorted(texts)
    assert got == dict(zip(order, test_suffix_dedup.brute([texts[d] for d in order]), strict=True))


def test_op7(spark, sf_dir, texts, monkeypatch):
    full = test_line_dedup.distance

    def distance(a, b):
        """No two strings are nearer than half the difference of their letters."""
        x, y = collections.Counter(a), collections.Counter(b)
        return 9 if sum(((x - y) + (y - x)).values()) > 2 * line_dedup.TAU else full(a, b)

    monkeypatch.setattr(test_line_dedup, "distance", distance)
    want = test_line_dedup.brute(sorted(texts.items()))
    got = {r.doc_id: r for r in QUERIES["op7_line_dedup"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for d, r in got.items():
        assert (list(r.removed), list(r.keepers), r.n_removed) == (*want[d], len(want[d][0])), d


def test_op8(spark, sf_dir, texts):
    model = quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    got = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        n, chars, symbols, dup, rep = test_quality_rules.brute(t)
        failed = n < 20 or 100 * rep > 30 * n
        x = np.array([[n, chars / max(n, 1), symbols / max(chars, 1), dup, rep / max(n, 1)]])
        kept = not failed and not any(rule.mask(x)[0] for rule in model.rules)
        assert (got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words, got[d].base_failed, got[d].kept) == (n, chars, symbols, dup, rep, failed, kept)


def test_op9(spark, sf_dir, texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op9_sentencepiece"](spark, sf_dir).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {d: lib.encode(t or "") for d, t in texts.items()}
    assert got == {d: (len(i), sha(",".join(map(str, i))), sha(lib.decode(i)), 0) for d, i in want.items()}


def test_op10(spark, sf_dir, texts):
    got = sorted(map(tuple, QUERIES["op10_near_dup"](spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == test_near_dup.brute(sorted(texts.items()))
