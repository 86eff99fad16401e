"""Scans, sinks and contracts."""
