"""Runnable jobs on tables. The work of each is a function of a session; `python -m jobs.NAME` is its command line."""
