"""fernweave: DataFrame operators for benchmark, vote, frame and timeline tables, and for text corpora."""
