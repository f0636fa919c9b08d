"""The registered queries: each operator on the given tables, with its SQL where SQL can say it."""

from labelkite.plans import source_queries, table_queries, text_queries, word_queries

_MODULES = (source_queries, text_queries, table_queries, word_queries)


def all_queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.registry.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in m.registry.sql.items()}
