"""URL filters by association rules.

Spark's FP-growth mines combinations of URL tokens that go with blocked labels. A rule needs support, a confidence
both absolute and relative to the share of blocked pages, and a surplus of blocked pages that chance would not give
(binomial tail, corrected for the number of combinations tested), all on the pages that no better rule blocks. The
rules that are left are matched by an inverted index from tokens to rules. Explicit host and path rules stand before them; the longest that
fits wins. Tokens that occur on the same pages are one item to the miner, so page templates do not multiply.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no explicit rule and is
judged by its (possibly empty) tokens; a label with neither quality nor toxic is not fitted on; without labels, or
where no rule passes, the verdict beside the explicit rules is allow; rows are judged one by one, so repeated rows
agree (and count once when fitting); of explicit rules of one length the first in text order wins; extra columns are
ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
SAMPLE_ROWS = 50_000
"""Labelled pages fitted on, at most: those with the smallest hashes of their ids."""
CONFIDENCE, LIFT, CHANCE = 0.5, 1.5, 0.05
"""Least confidence; least confidence in shares of blocked pages (as far as 0.95); chance that any rule of a list is noise."""
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TARGET = "=block"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    before, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match("[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match("[^?#]*", rest[len(host) :])[0]


def tokens(url: str | None) -> list[str]:
    """Distinct tokens: scheme, host labels, words of the path (numbers by length), keys of the query."""
    host, path = split_url(url)
    out = {"s:" + url.partition("://")[0].translate(LOWER)} if url and "://" in url else set()
    out.update("h:" + x for x in host.split(".") if x)
    out.update(f"p:#{len(x)}" if x.isdigit() else "p:" + x for x in re.split(r"[\W_]+", path.lower()) if x)
    query = (url or "").partition("?")[2].partition("#")[0]
    out.update("q:" + x.partition("=")[0] for x in query.split("&") if x)
    return sorted(out)


@dataclass(frozen=True)
class Explicit:
    text: str
    verdict: str

    def fits(self, host: str, path: str) -> bool:
        name, slash, rest = self.text.partition("/")
        return (host == name or host.endswith("." + name)) and path.startswith(slash + rest)


class Matcher:
    """Mined rules behind an inverted index: a rule fits when all its tokens have been met."""

    def __init__(self, rules: list[tuple[str, ...]], explicit: tuple[tuple[str, str], ...] = RULES):
        self.sizes = [len(r) for r in rules]
        self.index: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            for t in rule:
                self.index.setdefault(t, []).append(k)
        self.explicit = sorted((Explicit(*x) for x in explicit), key=lambda r: (-len(r.text), r.text))

    def blocked(self, url: str | None) -> bool:
        met: dict[int, int] = {}
        for t in tokens(url) if self.index else ():
            for k in self.index.get(t, ()):
                met[k] = met.get(k, 0) + 1
                if met[k] == self.sizes[k]:
                    return True
        return False

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = split_url(url)
        rule = next((r for r in self.explicit if r.fits(host, path)), None)
        return host, path, rule and rule.text, rule.verdict if rule else "block" if self.blocked(url) else "allow"


def _tokens_of(urls: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in urls:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tokens(u) for u in b.column(1).to_pylist()], pa.list_(pa.string()))], ["bad", "tokens"])


def surplus(n: int, hits: int, share: float) -> float:
    """Chance of at least ``hits`` blocked pages among n if each is blocked with the chance ``share``."""
    if share >= 1:
        return 1.0
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    i = np.arange(hits, n + 1)
    return min(1.0, float(np.exp(log[n] - log[i] - log[n - i] + i * np.log(share) + (n - i) * np.log1p(-share)).sum()))


def mine(pages: DataFrame, labels: DataFrame, support: float = 0.002, confidence: float = CONFIDENCE, lift: float = LIFT, chance: float = CHANCE, rows: int = SAMPLE_ROWS) -> list[tuple[str, ...]]:
    """Token combinations whose pages are blocked (quality 0 or toxic 1) more than chance explains."""
    from pyspark.ml.fpm import FPGrowth

    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    marks = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    known = pages.select("page_id", "url").distinct().join(marks, pages["page_id"] == marks["doc_id"]).select("page_id", "url", "bad")
    sample = materialize(known.orderBy(F.xxhash64("page_id"), "page_id", "url").limit(rows).select("bad", "url").mapInArrow(_tokens_of, "bad int, tokens array<string>").withColumn("row", F.monotonically_increasing_id()), "labelled-urls")
    n, blocked = sample.agg(F.count("*"), F.sum("bad")).first()
    if not n or not blocked:
        return []
    least, share = max(5, support * n), blocked / n
    floor = max(confidence, min(0.95, lift * share))
    # Tokens of the same pages are one item, named by the first of them.
    marked = sample.select(F.xxhash64("row").alias("__h"), F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.bit_xor("__h").alias("x"), F.sum(F.col("__h").cast("decimal(38,0)")).alias("s"))
    alike: dict[tuple, list[str]] = {}
    for r in marked.where(F.col("n") >= least).orderBy("t").collect():
        alike.setdefault((r["n"], r["x"], r["s"]), []).append(r["t"])
    items_of = {ts[0] for ts in alike.values()}

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[t for t in ts if t in items_of] + [TARGET] * mark for mark, ts in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["items"])

    model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=floor).fit(sample.select("bad", "tokens").mapInArrow(items, "items array<string>"))
    tests = model.freqItemsets.where(~F.array_contains("items", TARGET)).count()
    found = model.associationRules.where(F.array_contains("consequent", TARGET)).select("antecedent", "confidence", "support").collect()
    # Where each item is among the sampled pages; rules go in order of confidence, and each has to pass on the pages
    # that none before it blocks. So a rule that a better one covers goes, and so does one that is better cut down.
    pages_ = sample.select("bad", "tokens").collect()
    bad_ = np.array([r["bad"] for r in pages_], bool)
    where = {t: np.zeros(len(pages_), bool) for t in items_of}
    for k, r in enumerate(pages_):
        for t in items_of.intersection(r["tokens"]):
            where[t][k] = True
    kept, free = [], np.ones(len(pages_), bool)
    for r in sorted(found, key=lambda r: (-r["confidence"], -r["support"], len(r["antecedent"]), sorted(r["antecedent"]))):
        met = free & np.logical_and.reduce([where[t] for t in r["antecedent"]])
        m, hits = int(met.sum()), int((met & bad_).sum())
        if hits >= least and hits >= floor * m and surplus(m, hits, share) * tests <= chance:
            kept.append(tuple(sorted(r["antecedent"])))
            free &= ~met
    return [k for k in kept if not any(set(other) < set(k) for other in kept)]


def judge(pages: DataFrame, rules: list[tuple[str, ...]], explicit: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(rules, explicit)
        for b in batches:
            rows = [m.judge(u) for u in b.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", F.col("url").cast("string")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
