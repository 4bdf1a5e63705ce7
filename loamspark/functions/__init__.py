"""Column functions: normalisers, urls, hashes, similarity and scoring."""
