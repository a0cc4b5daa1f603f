"""Operators of a training-data pipeline: near-duplicates, licences, languages, lines, quality, web captures,
benchmark leaks, page text, byte-pair codes and language-model scores.

Nothing outside this subpackage imports it. Each module holds one operator; `queries` registers them.
"""
