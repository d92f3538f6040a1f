"""The formula language: what may stand in expressions and masks."""
