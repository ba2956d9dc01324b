"""Training-data operators: dedup, joins, classifiers, scans, mixing, search, tokenizing.

Each module holds one operator with a general interface; ``queries`` binds
them to the tables. Nothing outside this folder imports it.
"""
