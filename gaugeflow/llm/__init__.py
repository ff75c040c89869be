"""Operators for preparing training corpora at cluster scale.

Each module holds one operator with a general interface; ``queries`` binds them
to the tables of a data directory and ``oracle`` holds the SQL they are checked
against.  Nothing outside this subpackage imports it.
"""
