"""Readers and writers: change log, event messages, snapshots, catalog and metadata."""
