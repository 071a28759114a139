"""Scans: DNS logs, capture files, intel feeds and responses, suffix rules."""
