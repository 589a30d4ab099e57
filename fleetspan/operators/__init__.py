"""Telemetry operators: each is a function DataFrame(s) -> DataFrame, with an explicit ``as_of``."""
