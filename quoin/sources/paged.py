"""A paged provider as a Spark data source: one input partition per group of symbols, pages fetched inside the task."""

from __future__ import annotations

import hashlib
import importlib
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Statuses that a retry may cure.
TRANSIENT = frozenset({408, 409, 425, 429, *range(500, 600)})


@dataclass
class Page:
    """One page of a provider's answer, as rows and as it came."""

    records: list[dict]
    next_page_token: str | None = None
    missing_symbols: list[str] = field(default_factory=list)
    original_payload: Any = None


class ProviderError(Exception):
    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


def with_retries(call: Callable[[], Any], attempts: int = 4, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Any:
    """``call``, again with doubling waits after transient errors; permanent ones are raised at once."""
    for attempt in range(attempts):
        try:
            return call()
        except (ProviderError, OSError, TimeoutError) as error:
            status = getattr(error, "status", None)
            if attempt + 1 == attempts or (status is not None and status not in TRANSIENT):
                raise
            sleep(wait * 2**attempt)
    raise AssertionError


def pages(fetch: Callable[[str | None], Page]) -> Iterator[Page]:
    """All pages, from the first (token None) to that without a next token; a token that comes twice is an error, not a loop."""
    token, seen = None, set()
    while True:
        page = with_retries(lambda: fetch(token))
        yield page
        token = page.next_page_token
        if token is None:
            return
        if token in seen:
            raise ProviderError(f"page token {token!r} came twice")
        seen.add(token)


def sliced(records: Sequence[dict], token: str | None, size: int) -> Page:
    """A page of records already at hand: the token is the place to go on from. What providers of made-up data answer with."""
    start = int(token or 0)
    part = list(records[start : start + size])
    return Page(part, str(start + size) if start + size < len(records) else None, original_payload={"records": part})


def package(answers: Sequence[Page]) -> dict:
    """All pages of a request as they came, and the symbols that none of them had: what is kept beside the parsed rows."""
    return {"pages": [p.records if p.original_payload is None else p.original_payload for p in answers], "missing_symbols": sorted({s for p in answers for s in p.missing_symbols})}


def request_key(provider: str, endpoint: str, symbols: Sequence[str], start: str, end: str) -> str:
    """Identity of a request, whatever the order and case of its symbols: the name its results are kept under."""
    parts = [provider, endpoint, *sorted({s.upper() for s in symbols}), start, end]
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def pick_adapter(adapters: dict[str, dict], priority: Sequence[str], allowed: Sequence[str]) -> str:
    """The first enabled adapter of an allowed type by priority, else the first enabled one."""
    enabled = [n for n, a in adapters.items() if a.get("enabled")]
    for name in priority:
        if name in enabled and adapters[name].get("type") in allowed:
            return name
    if not enabled:
        raise ValueError("no adapter is enabled")
    return enabled[0]


class _Symbols(InputPartition):
    def __init__(self, symbols: list[str]) -> None:
        self.symbols = symbols


class PagedReader(DataSourceReader):
    def __init__(self, schema, options: dict) -> None:
        self.names = schema.fieldNames()
        self.symbols = [s for s in options.get("symbols", "").split(",") if s]
        self.group = int(options.get("symbols_a_task", "50"))
        self.provider = options["provider"]  # module:function(symbols, token) -> Page
        self.missing = options.get("rows", "records") == "missing"
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return [_Symbols(self.symbols[i : i + self.group]) for i in range(0, len(self.symbols), self.group)] or [_Symbols([])]

    def read(self, partition: _Symbols) -> Iterator[tuple]:
        if not partition.symbols:
            return
        module, _, name = self.provider.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for page in pages(lambda token: fetch(partition.symbols, token)):
            if self.missing:
                yield from ((s,) for s in page.missing_symbols)
                continue
            for record in page.records:
                yield tuple(record.get(n) for n in self.names)


class PagedSource(DataSource):
    """spark.read.format("paged").schema(...).option("provider", "module:function").option("symbols", "A,B").load(); with option
    "rows" = "missing" the symbols that the provider does not have, in a schema of one string."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, dict(self.options))
