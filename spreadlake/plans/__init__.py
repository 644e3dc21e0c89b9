"""Composed research plans and the catalogue of registered queries."""
