"""Query text to a tree, and the tree to columns."""
