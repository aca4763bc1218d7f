"""Readers and writers of logs, snapshots, labels and records."""
