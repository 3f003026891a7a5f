"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from feedweave.llm import bpe, ctw, decontaminate, fingerprint, html_extract, language_id, minhash, pii, quality, secret_scan

_MODULES = (secret_scan, fingerprint, html_extract, quality, pii, language_id, minhash, decontaminate, ctw, bpe)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
