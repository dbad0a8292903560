"""Readers and writers: datasets, vector dumps, document stores, configs, results."""
