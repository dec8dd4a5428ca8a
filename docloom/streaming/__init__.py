"""Keyed state over event streams, each with a batch twin that gives the same rows."""
