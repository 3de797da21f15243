"""The registered queries, and the SQL that each is compared with."""

from __future__ import annotations

from lodestack.plans import derived, events, files, pages, rewriting, rules, tables

QUERIES = {**pages.QUERIES, **files.QUERIES, **events.QUERIES, **tables.QUERIES, **derived.QUERIES, **rewriting.QUERIES, **rules.QUERIES}
SQL = {**pages.SQL, **files.SQL, **events.SQL, **tables.SQL, **derived.SQL, **rewriting.SQL, **rules.SQL}
