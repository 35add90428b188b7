"""Spark jobs for course captures, timetables and Office files."""
