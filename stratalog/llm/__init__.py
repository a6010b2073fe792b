"""Operators for large training-data pipelines.

Each module holds one operator with a general interface; ``queries`` holds the
thin ``opN_<name>`` queries that apply them to whole tables. Nothing outside
this subpackage imports it.
"""
