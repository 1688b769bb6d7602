"""Operators for preparing language-model training data.

Nothing outside this subpackage (and the guarded hook in ``__spark_entry__``)
imports it.
"""
