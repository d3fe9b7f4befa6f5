"""Training-data operators: one module each, plus the queries built on them.

Nothing outside this folder imports it.
"""
