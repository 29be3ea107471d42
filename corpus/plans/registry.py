"""All queries of the library outside the llm subpackage, by name, and their SQL."""

from __future__ import annotations

from . import datasets, inference, matrix, relational, texts

QUERIES = {k: v for part in (matrix, inference, relational, datasets, texts) for k, v in part.QUERIES.items()}
SQL = {k: v for part in (matrix, inference, relational, datasets, texts) for k, v in part.SQL.items()}
FLAGSHIP = "r6_effect_sizes"
