"""Catalog operators: ``DataFrame`` in, ``DataFrame`` out, all lazy."""
