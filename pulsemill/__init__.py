"""Spark jobs that turn large tables of short market posts into hourly signals."""
