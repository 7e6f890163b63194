"""Routing of arriving queries."""
