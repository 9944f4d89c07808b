"""Scans: lake layers, landed payloads, CSV and JDBC."""
