"""Datasets on disk: layers, catalog, readers and writers."""
