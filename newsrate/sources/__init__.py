"""Readers: SQL tables, files, landed feed pages, price bars, saved post pages."""
