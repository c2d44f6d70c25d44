"""Catalogue, price-history and matching analytics expressed as Spark DataFrame operators."""
