"""Queries over a record log, each a function from DataFrames to a DataFrame.

A log has the columns key, timestamp, blob_id, seq and is_deleted, and where an
operator reads them meta (map<string,binary>) and data (binary). Versions of a
key are ordered by (timestamp, blob_id, seq); every read walks that order from
the newest and stops at the first tombstone.
"""
