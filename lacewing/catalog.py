"""Queries by name, with the SQL that checks them."""

from __future__ import annotations

from .plans import catalogue, ledgers, official, prices, shop, stores, streams, texts

PARTS = (prices, catalogue, texts, streams, shop, official, ledgers, stores)
QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
SQL: dict = {name: sql for part in PARTS for name, sql in part.SQL.items()}
FLAGSHIP = "price_selection"
