"""Whole jobs built from the operators: backup, dashboard, the user-facing API."""
