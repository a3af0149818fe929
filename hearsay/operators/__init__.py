"""Data operators: matching, scoring, response parsing and table merges."""
