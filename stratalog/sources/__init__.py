"""Record logs from tables and from binary blob files."""
