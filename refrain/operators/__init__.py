"""Operators: functions ``DataFrame -> DataFrame`` over canonical messages and patterns."""
