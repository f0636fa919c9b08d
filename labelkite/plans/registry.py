"""A list of queries, each with its SQL where SQL can express it."""

from __future__ import annotations


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def register(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return register
