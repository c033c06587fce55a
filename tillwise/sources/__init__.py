"""Readers, sinks and the mapping of the test tables onto the data model."""
