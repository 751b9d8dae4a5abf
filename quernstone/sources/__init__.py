"""Sources: recorded payloads, calendars, candidate pages."""
