"""DataFrame transforms over correction records, and their reports."""
