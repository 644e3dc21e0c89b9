"""Readers, resamplers, calendars, configuration tables and writers."""
