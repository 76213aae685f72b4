"""Palimpsest: a multi-version key-value log engine expressed as Spark plans."""
