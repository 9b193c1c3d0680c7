"""Operators for preparing training text: archives, token counts, near duplicates, mixing, token
files, quality, language-model scores, decontamination, licences and toxicity.

Nothing else in the library imports this subpackage. Every operator takes the columns it needs by
name and returns a frame of its own columns, so further columns of the input never clash.
Executors import this package: ship it with ``--py-files`` where it is not installed.
"""
