"""Readers and parsers that turn landed payloads and pages into tables, and the fixed dimensions."""
