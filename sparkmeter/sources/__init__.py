"""Readers and writers: log trees, the three log dialects, prices, manifests, results."""
