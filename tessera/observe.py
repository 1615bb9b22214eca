"""Query logs, slow queries and redaction.

Values are redacted by walking the query's own predicates, so a column is recognised however the text would quote it.
"""

from __future__ import annotations

import itertools
import logging
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .errors import NoRows
from .functions.items import Item
from .functions.refs import And, Between, ColumnRef, Compare, Document, Exists, In, InQuery, Not, Or, SqlText

MASK = "***"
#: Column names whose values never reach a log.
SENSITIVE = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_token", "refresh_token", "private_key", "privatekey", "credential", "credentials")
#: Further ones of our own.
SENSITIVE_TOO = ("pwd", "credit_card", "ssn")
#: Seconds; a Spark job takes longer than a look-up in a database, hence more than the usual fraction of a second.
SLOW = 5.0


@dataclass(frozen=True)
class QueryInfo:
    op: str
    table: str
    text: str
    args: list[tuple[str, Any]]
    seconds: float
    rows: int | None
    error: Exception | None
    #: The statement as text that can be pasted, made when it is asked for.
    sql: Callable[[], str] | None = None


@dataclass
class Observer:
    """Where an engine's queries are told."""

    logger: logging.Logger = field(default_factory=lambda: logging.getLogger("tessera"))
    slow: float = SLOW
    sensitive: set[str] = field(default_factory=lambda: {*SENSITIVE, *SENSITIVE_TOO})
    redact: bool = True
    hooks: list[Callable[[QueryInfo], None]] = field(default_factory=list)

    def add_sensitive(self, *columns: str) -> None:
        self.sensitive |= {c.lower() for c in columns}

    def args(self, p: Any) -> list[tuple[str, Any]]:
        """Column and value of every literal in a predicate, values of sensitive columns masked."""
        if isinstance(p, (And, Or)):
            return [a for x in p.parts for a in self.args(x)]
        if isinstance(p, Not):
            return self.args(p.part)
        if isinstance(p, Exists):
            return self.query_args(p.query)
        if isinstance(p, InQuery):
            return self.query_args(p.query)
        if isinstance(p, SqlText):
            return []  # its values are part of the text
        name = name_of(getattr(p, "left", None))
        if isinstance(p, Compare):
            return [] if isinstance(p.right, (ColumnRef, Item)) else [(name, self.mask(name, p.right))]
        if isinstance(p, Between):
            return [(name, self.mask(name, x)) for x in (p.low, p.high) if not isinstance(x, (ColumnRef, Item))]
        if isinstance(p, In):
            return [(name, self.mask(name, v)) for v in p.values]
        return []

    def query_args(self, q: Any) -> list[tuple[str, Any]]:
        """The same for all of a query: conditions of joins, WHERE and HAVING, and of the arms of a set operation."""
        if hasattr(q, "arms"):
            return [a for x in q.arms for a in self.query_args(x)]
        found = [*(j.on for j in getattr(q, "joins", ())), *getattr(q, "predicates", ()), getattr(q, "condition", None)]
        return [a for p in found if p is not None for a in self.args(p)]

    def raw_args(self, sql: str, args: Any) -> list[tuple[str, Any]]:
        """Arguments of a raw statement, each with its name, or the column that it is compared with or set to."""
        if isinstance(args, dict):
            behind = {m[2]: m[1] for m in re.finditer(r"(\w+)`?\s*(?:=|<>|!=|<=|>=|<|>|\blike\b)\s*:(\w+)", sql, re.I)}
            return [(k, MASK if self.redacted(k) or self.redacted(behind.get(k, "")) else v) for k, v in args.items()]
        names = [m[1] or "" for m in re.finditer(r"(?:(\w+)`?\s*(?:=|<>|!=|<=|>=|<|>|\blike\b)\s*)?\?", sql, re.I)]
        columns = re.match(r"\s*insert\s+into\s+`?\w+`?\s*\(([^)]*)\)\s*values", sql, re.I)
        if columns:
            listed = [c.strip(" `\n") for c in columns[1].split(",")]
            names = [listed[i % len(listed)] for i in range(len(names))]
        return [(n, self.mask(n, v)) for n, v in itertools.zip_longest(names, args or (), fillvalue="")][: len(args or ())]

    def redacted(self, column: str) -> bool:
        return self.redact and column.lower() in self.sensitive

    def mask(self, column: str, value: Any) -> Any:
        return MASK if self.redacted(column) else value

    def values(self, patch: dict[str, Any]) -> list[tuple[str, Any]]:
        return [(k, self.mask(k, v)) for k, v in patch.items()]

    def tell(self, info: QueryInfo) -> None:
        """Errors as ERROR, slow queries as WARNING, the rest (a missing row too) as DEBUG. A hook's error is logged only."""
        for h in self.hooks:
            try:
                h(info)
            except Exception:
                self.logger.exception("a query hook failed")
        if info.error is not None and not isinstance(info.error, NoRows):
            level = logging.ERROR
        else:
            level = logging.WARNING if info.seconds >= self.slow else logging.DEBUG
        self.logger.log(level, "%s %s args=%s seconds=%.3f rows=%s error=%s", info.op, info.text, info.args, info.seconds, info.rows, info.error, extra={"query": info})


def name_of(x: Any) -> str:
    """The column that a value is compared with."""
    if isinstance(x, ColumnRef):
        return x.name
    if isinstance(x, (Item, Document)):
        return x.column.name if x.column is not None else ""
    words = re.findall(r"\w+", getattr(x, "sql", ""))
    return words[-1] if words else ""


class DebugSql(logging.Handler):
    """Writes each query as one line of SQL that can be pasted, with values in place (sensitive ones masked), and what
    became of it."""

    def __init__(self, stream: Any = None, level: int = logging.DEBUG) -> None:
        super().__init__(level)
        self.stream = stream or sys.stderr

    def emit(self, record: logging.LogRecord) -> None:
        if (info := getattr(record, "query", None)) is None:
            return
        try:
            text = " ".join((info.sql() if info.sql else info.text).split())
            tail = f" -- {info.op} {info.seconds * 1000:.1f} ms" + (f", {info.rows} rows" if info.rows is not None else "") + (f", {type(info.error).__name__}: {str(info.error).splitlines()[0] if str(info.error) else ''}" if info.error else "")
            self.stream.write(text + ";" + tail + "\n")
        except Exception:
            self.handleError(record)
