"""Document-corpus analytics on Spark: parse, chunk, index, rank, assemble and track collections of texts."""
