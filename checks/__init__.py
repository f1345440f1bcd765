"""Mapping of the driver tables onto the data model, the registered queries, and their SQL oracles."""
