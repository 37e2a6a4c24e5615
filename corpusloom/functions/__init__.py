"""Column functions: tokens, keys, hashes, paths, versions and display forms."""
