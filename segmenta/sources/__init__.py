"""Where segments, corpora and recordings come from."""
