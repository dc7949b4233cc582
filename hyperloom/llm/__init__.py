"""Training-data operators: language ID, near-duplicates, packing, LM scoring, mixing,
fingerprints, quality, chat formatting and toxicity, all over Spark DataFrames."""
