"""Operators for preparing language-model training data at scale.

Every module holds one operator with its general interface, and the thin query
``opN_<name>`` that applies it to a whole table. Nothing else in the library
imports this subpackage.
"""
