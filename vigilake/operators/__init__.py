"""Operators: functions from frames to frames."""
