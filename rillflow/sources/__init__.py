"""Readers and writers of readings, manifests, layouts, networks and configurations."""
