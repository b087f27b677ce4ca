"""Source trees: finding files, extracting rows, caching."""
