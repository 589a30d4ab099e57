"""Composite jobs built from the operators: alerts, reports, data dictionary, statements."""
