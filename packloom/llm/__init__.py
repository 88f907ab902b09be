"""Operators for preparing large text corpora, each expressed as Spark jobs.

Nothing outside this subpackage imports it.
"""
