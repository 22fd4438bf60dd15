"""All registered queries and their SQL statements."""

from __future__ import annotations

from seqloom.plans import features, language, models, text, translation, vectors

_MODULES = (text, language, features, vectors, translation, models)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: statement for module in _MODULES for name, statement in module.SQL.items()}
