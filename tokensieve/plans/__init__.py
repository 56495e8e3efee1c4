"""Queries over the tables, each with the DuckDB SQL it is checked against."""
