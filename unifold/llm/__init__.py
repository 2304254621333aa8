"""Training-data operators: dedup, decontamination, scoring, filtering, tokens.

Nothing else in the library imports this subpackage. ``queries()`` and
``oracle_sql()`` list what ``__spark_entry__`` registers.
"""
