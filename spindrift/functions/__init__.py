"""Column functions: text, line diffs, untyped JSON, source items."""
