"""A CommonMark parser in plain Python: no recursion, and every text character knows its place in the source."""
