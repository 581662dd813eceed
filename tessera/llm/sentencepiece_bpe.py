"""SentencePiece encoding and decoding of merge-type vocabularies.

A score-ordered agenda of adjacent symbol pairs merges each unit of a text; units are the parts between which
no piece of the vocabulary reaches, so the ids of a text are those of its units in a row. Each unit that
enters the cache is checked against the sentencepiece library, batch by batch. Where the two differ the library's
ids are used, and the result says so: ``mismatches`` counts such units of a document (none is known).

Defined results: null text is empty text (no ids); very long texts are cut into units only; repeated rows give
the same ids; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import emptied

SPACE = "▁"
SHORT, NONE = 48, float("-inf")
CHUNK_CHARS = 1_000_000
CACHE_UNITS = 600_000
"""Units kept by a worker; the cache is emptied beyond that."""


class Codec:
    def __init__(self, model: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.lib.get_piece_size()
        self.pieces = [self.lib.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i)}
        self.score = {p: self.lib.get_score(i) for i, p in enumerate(self.pieces) if i not in special}
        self.id = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if self.lib.is_byte(i)}
        of_byte = {i: b for b, i in self.byte.items()}
        self.raw = [bytes([of_byte[i]]) if i in of_byte else self.pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.decimal = list(map(str, range(n)))
        assert not any(re.search(f"[^{SPACE}]{SPACE}", p) or (len(p) > 1 and "\n" in p) for p in self.id), "units would not be independent"
        self.units = re.compile(" *[^ \n]+|\n| +").findall
        self.cache: dict[str, str] = {}
        self.differ: dict[str, bytes] = {}
        self.mismatches: set[str] = set()
        """Cached units whose agenda and library ids differ."""

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit (spaces already as SPACE)."""
        symbols = self._short(list(unit)) if len(unit) <= SHORT else self._long(list(unit))
        try:
            return list(map(self.id.__getitem__, symbols))
        except KeyError:
            return [i for s in symbols for i in ([self.id[s]] if s in self.id else [self.byte[b] for b in s.encode()])]

    def _short(self, symbols: list[str]) -> list[str]:
        """The agenda as a list beside the symbols: for a few pairs a scan beats a heap. Ties go to the left."""
        score = self.score.get
        agenda = [score(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := max(agenda)) > NONE:
            i = agenda.index(best)
            symbols[i : i + 2] = (merged := symbols[i] + symbols[i + 1],)
            del agenda[i]
            if i:
                agenda[i - 1] = score(symbols[i - 1] + merged, NONE)
            if i < len(agenda):
                agenda[i] = score(merged + symbols[i + 1], NONE)
        return symbols

    def _long(self, symbols: list[str | None]) -> list[str]:
        """The agenda as a heap, for units of any length: n log n."""
        score, n = self.score, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(-score[m], i, m) for i in range(n - 1) if (m := symbols[i] + symbols[i + 1]) in score]
        heapq.heapify(agenda)
        while agenda:
            _, i, merged = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != merged:
                continue  # one of the two was merged in the meantime
            symbols[i], symbols[j] = merged, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := merged + symbols[k]) in score:
                    heapq.heappush(agenda, (-score[m], i, m))
            if (h := before[i]) >= 0 and (m := symbols[h] + merged) in score:
                heapq.heappush(agenda, (-score[m], h, m))
        return [s for s in symbols if s is not None]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def learn(self, units: list[str]) -> None:
        """Encodes units that the cache lacks and checks them against the library."""
        # A unit that starts with a space is what the library makes of the rest with its dummy prefix; before
        # any other a line feed is put, whose ids are taken off again.
        theirs = self.lib.encode([u[1:] if u[0] == " " < u else "\n" + u for u in units], num_threads=1)
        decimal = self.decimal.__getitem__
        for u, ids in zip(units, theirs, strict=True):
            ids = ids if u[0] == " " < u else ids[2:]
            ours = self.merge(u.replace(" ", SPACE))
            if ours != ids:
                self.mismatches.add(u)
                ours = ids
            self.cache[u] = ",".join(map(decimal, ours))
            if (back := self.decode_bytes(ours)) != u.encode():
                self.differ[u] = back

    def forget(self) -> None:
        self.cache.clear()
        self.differ.clear()
        self.mismatches.clear()

    def parts(self, texts: list[str]) -> list[list[str]]:
        """The units of each text, all in the cache afterwards."""
        out = [self.units(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        known = self.cache.keys()
        if missing := set().union(*out) - known:
            if len(known) + len(missing) > CACHE_UNITS:
                self.forget()
                missing = set().union(*out)
            self.learn(list(missing))
        return out

    def ids_text(self, units: list[str]) -> str:
        """Decimal ids joined by commas; a unit without ids (a lone NUL) adds none."""
        return ",".join(filter(None, map(self.cache.__getitem__, units)))

    def decoded(self, units: list[str]) -> bytes:
        """The units' ids decoded; only units that decode to something else are kept beside the cache."""
        out = "".join(units).encode() if self.differ.keys().isdisjoint(units) else b"".join([self.differ[u] if u in self.differ else u.encode() for u in units])
        return out.removeprefix(b" ")

    def encode(self, text: str) -> list[int]:
        joined = self.ids_text(self.parts([text])[0])
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace").removeprefix(" ")


_codecs: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """One codec for each worker process, kept between tasks."""
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def _chunks(column: pa.Array) -> Iterator[list[str]]:
    """Texts of a batch, a few at a time (about CHUNK_CHARS characters), so that their units take bounded memory."""
    chunk, size = [], 0
    for t in column:
        chunk.append(t.as_py() or "")
        size += len(chunk[-1])
        if size > CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
    yield chunk


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            ids = [c.encode(t) for chunk in _chunks(b.column(1)) for t in chunk]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, mismatches: the same encoding and decoding, reduced in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(model), hashlib.sha256
        for b in batches:
            n, a, d, m = [], [], [], []
            for chunk in _chunks(b.column(1)):
                for units in c.parts(chunk):
                    ids = c.ids_text(units)
                    n.append(ids.count(",") + 1 if ids else 0)
                    a.append(sha(ids.encode()).hexdigest())
                    d.append(sha(c.decoded(units)).hexdigest())
                    m.append(sum(u in c.mismatches for u in units) if c.mismatches else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(m, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "mismatches"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: emptied(run(batches), codec(model).forget), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, mismatches long")
