"""Readers of files, lockfiles and feeds, and writers of reports."""
