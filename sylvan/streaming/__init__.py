"""Following a tree that changes."""
