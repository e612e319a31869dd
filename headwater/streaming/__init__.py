"""Incremental processing of arriving sites."""
