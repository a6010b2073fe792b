"""Streams of records: append, and stateful newest version and insert."""
