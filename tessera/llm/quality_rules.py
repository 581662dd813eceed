"""Quality rules as a learned decision list (native: DataFrame functions only on the main path).

Text statistics are Spark expressions over the whole text. Sequential covering grows threshold conjunctions
on a bounded sample of labelled rows, prunes each on held-back rows, and emits one ordered CASE expression.

Defined results: null or empty text has no words (all counts 0, base_failed, not kept); null doc_id rows are
kept in the output with their own statistics; repeated rows are judged alike; extra columns are ignored by
``judge`` and pass through ``filter_documents``; an empty or one-sided label table gives an empty list (keep all
that pass the base rules).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WS

WINDOW = 8
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_lines", "repeat_share")
SAMPLE_ROWS = 6000
"""At most so many labelled ids are fitted on (those with the smallest hashes), and twice as many rows, if ids repeat."""
MOST_RULES, MOST_CONDITIONS = 16, 4
"""Rules of a list, and conditions of a rule, at most."""


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{WS}]+"), "")


def _repeat_words(words: Column, size: int) -> Column:
    """Words that lie in a window of ``size`` words whose 64-bit hash occurs twice or more in the text."""
    n = F.size(words) - (size - 1)
    hashes = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, size))))

    def positions(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        twice = lambda s: F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1))
        found = F.element_at(F.transform(F.array(ordered), twice), 1)
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(-size).cast("int").alias("last"), F.lit(0).cast("long").alias("sum"))
        step = lambda a, x: F.struct(x.cast("int").alias("last"), (a["sum"] + F.least(F.lit(size), x - a["last"]).cast("long")).alias("sum"))
        return F.aggregate(p, start, step, lambda a: a["sum"])

    one = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(positions(h))).otherwise(F.lit(0).cast("long"))
    return F.coalesce(F.element_at(F.transform(F.array(hashes), one), 1), F.lit(0).cast("long"))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of COUNTS added (long).

    The counts leave through a generator of one row: the optimizer doesn't copy expressions through it, so a
    filter on them doesn't compute them again."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    counts = {
        "n_words": F.size("__words"),
        "word_chars": F.length(F.array_join("__words", "")),
        "n_symbols": F.length(F.regexp_replace(whole, f"[^{SYMBOLS}]+", "")),
        "n_dup_lines": F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1),
        "n_repeat_words": _repeat_words(F.col("__words"), WINDOW),
    }
    out = docs.withColumn("__words", words_of(whole))
    return out.select("*", F.inline(F.array(F.struct(*(c.cast("long").alias(k) for k, c in counts.items()))))).drop("__words")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Size-free features of the counts; no division by zero."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
    }


@dataclass(frozen=True)
class Rule:
    """Rejects rows that meet all conditions: (feature, ">=" or "<", threshold)."""

    conditions: tuple[tuple[str, str, float], ...]

    def mask(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, op, cut in self.conditions:
            v = x[:, FEATURES.index(name)]
            out &= v >= cut if op == ">=" else v < cut
        return out

    def column(self) -> Column:
        cols, out = features(), F.lit(True)
        for name, op, cut in self.conditions:
            out = out & (cols[name] >= cut if op == ">=" else cols[name] < cut)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{a} {b} {c:.6g}" for a, b, c in self.conditions)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def rejected(self) -> Column:
        """The ordered conditional expression: the first rule that fits rejects, otherwise nothing does."""
        out = F.lit(False)
        for rule in reversed(self.rules):
            out = F.when(rule.column(), F.lit(True)).otherwise(out)
        return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> tuple:
    """Adds the condition of the largest FOIL gain until no good row is left."""
    alive, conditions = np.ones(len(x), bool), []
    while len(conditions) < most:
        p0, n0 = int((alive & bad).sum()), int((alive & ~bad).sum())
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for f, name in enumerate(FEATURES):
            v, b = x[alive, f], bad[alive]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            pos, total = np.cumsum(b), np.arange(1, len(v) + 1)
            cut = np.nonzero(v[1:] > v[:-1])[0]
            if not len(cut):
                continue
            for op, p, n in (("<", pos[cut], (total - pos)[cut]), (">=", p0 - pos[cut], n0 - (total - pos)[cut])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (name, op, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        alive &= Rule((best[1],)).mask(x)
    return tuple(conditions)


def _prune(conditions: tuple, x: np.ndarray, bad: np.ndarray) -> tuple:
    """The shortest beginning of the conjunction that has the best (p - n) / (p + n) on held-back rows."""
    best, kept = -2.0, conditions
    for k in range(1, len(conditions) + 1):
        m = Rule(conditions[:k]).mask(x)
        p, n = int((m & bad).sum()), int((m & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best + 1e-12:
            best, kept = worth, conditions[:k]
    return kept


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.95, most_rules: int = MOST_RULES, most_conditions: int = MOST_CONDITIONS) -> DecisionList:
    """Sequential covering: x holds a row of FEATURES for each labelled text, bad its label.

    Every third row is held back for pruning. A rule enters if its precision over all rows that no earlier rule
    takes reaches ``precision`` and it takes at least 3 bad rows; the first that fails ends the list."""
    rules: list[Rule] = []
    left, third = np.ones(len(x), bool), np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and (left & bad).any():
        grown = _grow(x[left & ~third], bad[left & ~third], most_conditions)
        if not grown:
            break
        rule = Rule(_prune(grown, x[left & third], bad[left & third]))
        m = rule.mask(x) & left
        p, n = int((m & bad).sum()), int((m & ~bad).sum())
        if p < 3 or p / (p + n) < precision:
            break
        rules.append(rule)
        left &= ~m
    return DecisionList(rules)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learns from at most ``rows`` labelled documents that pass the base rules; only their five numbers and label reach the driver."""
    sample = (
        labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__q"))
        .orderBy(F.xxhash64("__id"), "__id").limit(rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    got = statistics(texts).where(~base_failed()).select("doc_id", "__q", *(c.alias(f"f_{k}") for k, c in features().items()))
    got = got.orderBy("doc_id", *(f"f_{k}" for k in FEATURES)).limit(2 * rows).collect()
    got.sort(key=lambda r: (hash((r["doc_id"] * 2654435761) % 2**32), r["doc_id"]))
    if not got:
        return DecisionList()
    x = np.array([[r[f"f_{k}"] for k in FEATURES] for r in got], float)
    return learn(x, np.array([r["__q"] == 0 for r in got]))


def judge(docs: DataFrame, model: DecisionList, text: str = "text") -> DataFrame:
    """docs with COUNTS, base_failed and kept added."""
    out = statistics(docs, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~model.rejected())


def filter_documents(docs: DataFrame, model: DecisionList) -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    kept = judge(docs.select(F.struct("*").alias("__row"), "text"), model).where("kept")
    return kept.select("__row.*")
