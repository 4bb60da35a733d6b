"""All queries of the subpackage: name to (query, SQL or None)."""

from __future__ import annotations

from . import queries_audit, queries_native, queries_pages, queries_text

QUERIES = {**queries_native.QUERIES, **queries_text.QUERIES, **queries_pages.QUERIES, **queries_audit.QUERIES}
