"""Scalar functions on text, dates, prices and addresses of pages."""
