"""Rewrites of dialect forms that Spark's parser lacks; everything else passes through.

``{fn timestampadd(SQL_TSI_DAY, n, ts)}``, ``{fn name(...)}``, ``FETCH FIRST n ROWS ONLY``, ``timestamp('...')``,
``LENGTH``/``CHAR_LENGTH``, ``UCASE``/``LCASE``, ``DSID()``, ``CURRENT SCHEMA``, ``USER``, integer division by ``/`` of
two integer literals or marked operands (``INTDIV(a, b)``), comparisons with ANY, SOME and ALL. String literals, quoted names and comments are left alone.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_UNITS = {"FRAC_SECOND": "MICROSECOND", "SECOND": "SECOND", "MINUTE": "MINUTE", "HOUR": "HOUR", "DAY": "DAY", "WEEK": "WEEK", "MONTH": "MONTH", "QUARTER": "QUARTER", "YEAR": "YEAR"}
_RULES = [
    (re.compile(r"\bSQL_TSI_(\w+)", re.I), lambda m: _UNITS[m[1].upper()]),
    (re.compile(r"\bOFFSET\s+(\d+)\s+ROWS?\s+FETCH\s+(?:FIRST|NEXT)(?:\s+(\d+))?\s+ROWS?\s+ONLY\b", re.I), lambda m: f"LIMIT {m[2] or 1} OFFSET {m[1]}"),
    (re.compile(r"\bFETCH\s+(?:FIRST|NEXT)(?:\s+(\d+))?\s+ROWS?\s+ONLY\b", re.I), lambda m: f"LIMIT {m[1] or 1}"),
    (re.compile(r"\bOFFSET\s+(\d+)\s+ROWS?\b", re.I), lambda m: f"OFFSET {m[1]}"),
    (re.compile(r"\bDSID\s*\(\s*\)", re.I), lambda m: "CAST(spark_partition_id() AS STRING)"),
    (re.compile(r"\bCURRENT\s+SCHEMA\b", re.I), lambda m: "current_schema()"),
    (re.compile(r"(?<![\w.])USER(?![\w(.])", re.I), lambda m: "current_user()"),
    (re.compile(r"\bINTDIV\s*\(([^(),]+),([^(),]+)\)", re.I), lambda m: f"({m[1]} div {m[2]})"),
]


def _blank(sql: str) -> tuple[str, list[str]]:
    """The text with literals and comments swapped for placeholders."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x01{len(kept) - 1}\x02"

    return _TOKEN.sub(keep, sql), kept


def _escapes(sql: str) -> str:
    """Takes off the braces of ``{fn call}``, inner ones first; ``{d ..}``, ``{t ..}`` and ``{ts ..}`` become literals."""
    last = None
    while last != sql:
        last = sql
        sql = re.sub(r"\{\s*fn\s+([^{}]*?)\s*\}", r"\1", sql, flags=re.I)
        sql = re.sub(r"\{\s*d\s+([^{}]*?)\s*\}", r"DATE \1", sql, flags=re.I)
        sql = re.sub(r"\{\s*ts\s+([^{}]*?)\s*\}", r"TIMESTAMP_NTZ \1", sql, flags=re.I)
    return sql


_QUANTIFIED = re.compile(r"([\w.]+)\s*(<>|<=|>=|=|<|>)\s*(ANY|SOME|ALL)\s*\(", re.I)


def _quantified(sql: str) -> str:
    """Comparisons with ANY, SOME or ALL of a subquery of one column. Spark has IN; the others compare with the least or
    largest value, so that no pair of rows is formed. ALL of no row is true; a null among the rows makes it unknown
    where it is not false."""
    while m := _QUANTIFIED.search(sql):
        end, depth = m.end(), 1
        while depth and end < len(sql):
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        x, op, all_, inner = m[1], m[2], m[3].upper() == "ALL", sql[m.end() : end - 1]
        of = lambda f, inner=inner: f"(SELECT {f} FROM ({inner}) AS __q(__v))"
        if (op, all_) in (("=", False), ("<>", True)):
            new = f"({x} {'NOT ' if all_ else ''}IN ({inner}))"
        elif op in ("=", "<>"):  # = ALL, <> ANY: the least and the largest value decide
            differs = f"({x} <> {of('min(__v)')} OR {x} <> {of('max(__v)')})"
            new = f"(CASE WHEN {of('count(*)')} = 0 THEN {str(all_).upper()} WHEN {differs} THEN {str(not all_).upper()} WHEN {of('count(*) - count(__v)')} = 0 THEN {'NOT ' if all_ else ''}{differs} END)"
        else:
            bound = of(f"{'max' if (op[0] == '>') == all_ else 'min'}(__v)")
            one = f"({x} {op} {bound})"
            new = one if not all_ else f"(CASE WHEN {of('count(*)')} = 0 THEN TRUE WHEN NOT {one} THEN FALSE WHEN {of('count(*) - count(__v)')} = 0 THEN {one} END)"
        sql = sql[: m.start()] + new + sql[end:]
    return sql


def to_spark(sql: str) -> str:
    """One statement, without its closing semicolon, as Spark SQL."""
    text, kept = _blank(sql.strip().rstrip(";"))
    text = _escapes(text)
    text = re.sub(r"\btimestamp\s*\(\s*(\x01\d+\x02)\s*\)", r"TIMESTAMP_NTZ \1", text, flags=re.I)
    text = re.sub(r"(?<!\w)date\s*\(\s*(\x01\d+\x02)\s*\)", r"DATE \1", text, flags=re.I)
    for pattern, new in _RULES:
        text = pattern.sub(new, text)
    text = _quantified(text)
    return re.sub(r"\x01(\d+)\x02", lambda m: kept[int(m[1])], text)
