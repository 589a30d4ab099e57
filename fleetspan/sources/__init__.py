"""Readers and writers of landed telemetry."""
