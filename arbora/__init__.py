"""Replica analytics on Spark: causality, diff, reconciliation, feeds, chunks, retention and events over file-tree catalogs."""
