"""Scalar functions of the log: key codec, sizes, checksums, hashes, names."""
