"""Pattern specifications and routing rules for batches of questions."""
