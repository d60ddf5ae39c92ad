"""Queries registered for the driver, by subject."""
