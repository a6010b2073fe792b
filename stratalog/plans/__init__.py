"""Named queries with their SQL, and the store."""
