"""Scans, extracts, load modes, sinks and exports."""
