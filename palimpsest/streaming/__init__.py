"""A store that batches and streams append to."""
