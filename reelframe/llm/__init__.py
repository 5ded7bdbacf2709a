"""Operators for large text corpora: one module per operator.

Every module holds a general operator, the query that applies it to the
tables of a data folder, and, where SQL can express the result, its SQL.
"""
