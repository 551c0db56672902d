"""Incremental forms of the decision and validation steps."""
