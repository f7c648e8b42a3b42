"""Part of the string-column engine."""
