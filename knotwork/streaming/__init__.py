"""Nothing here yet: the traversal language has no streaming operator.  New rows come in by bulk load or transaction."""
