"""Registered query plans, shared-scan plans and physical-layout helpers."""
