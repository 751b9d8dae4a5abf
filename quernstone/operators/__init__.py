"""Operators on tables of activities: filters, sorts, facets, profiles, joins."""
