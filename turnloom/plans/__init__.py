"""Adapters from the driver's tables, the registered queries, and their DuckDB SQL."""
