"""Readers and writers: link registry, click table, click queue, test-data views."""
