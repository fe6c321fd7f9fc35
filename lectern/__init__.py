"""Document structuring and narration planning over Spark tables."""
