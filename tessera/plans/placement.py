"""Placement clauses of CREATE TABLE, read apart from the statement. Those that change where rows lie become plan
hints; redundancy, persistence and server groups are kept as facts, for no result depends on them."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Placement:
    kind: str = "partitioned"  # partitioned or replicated
    method: str | None = None  # column, list, range or primary key
    columns: tuple[str, ...] = ()
    colocate: str | None = None
    buckets: int | None = None
    redundancy: int = 0
    persistent: bool = False
    offheap: bool = False
    server_groups: tuple[str, ...] = ()
    eviction: tuple[str, int, str] | None = None  # (LRUCOUNT, n, DESTROY)
    expire: tuple[str, int, str] | None = None  # (TIMETOLIVE, seconds, DESTROY)


def _names(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def placement(ddl: str) -> Placement:
    """The clauses of one CREATE TABLE statement."""
    text = re.sub(r"'(?:[^']|'')*'", "''", ddl)
    find = lambda pattern: re.search(pattern, text, re.I | re.S)
    by = find(r"\bPARTITION\s+BY\s+(COLUMN|LIST|RANGE|PRIMARY\s+KEY)\s*(?:\(([^)]*)\))?")
    evict = find(r"\bEVICTION\s+BY\s+(LRUCOUNT|LRUMEMSIZE|LRUHEAPPERCENT)\s*(\d+)?\s*EVICTACTION\s+(DESTROY|OVERFLOW)")
    expire = find(r"\bEXPIRE\s+(?:ENTRY|TABLE)\s+WITH\s+(TIMETOLIVE|IDLETIME)\s+(\d+)\s+ACTION\s+(\w+)")
    groups, near, n, copies = find(r"\bSERVER\s+GROUPS\s*\(([^)]*)\)"), find(r"\bCOLOCATE\s+WITH\s*\(([^)]*)\)"), find(r"\bBUCKETS\s+(\d+)"), find(r"\bREDUNDANCY\s+(\d+)")
    return Placement(
        "replicated" if find(r"\bREPLICATE\b") else "partitioned", by and " ".join(by[1].lower().split()), _names(by[2] or "") if by else (), near and near[1].strip(), n and int(n[1]), int(copies[1]) if copies else 0,
        bool(find(r"\bPERSISTENT\b")), bool(find(r"\bOFFHEAP\b")), _names(groups[1]) if groups else (), evict and (evict[1].upper(), int(evict[2] or 0), evict[3].upper()), expire and (expire[1].upper(), int(expire[2]), expire[3].upper()),
    )
