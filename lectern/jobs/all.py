"""Importing this module registers every query."""

from lectern.jobs import course_jobs, function_jobs, office_jobs, timetable_jobs  # noqa: F401
from lectern.jobs.registry import ORACLES, QUERIES  # noqa: F401
