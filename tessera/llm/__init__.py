"""Training-data operators: mixing, near-duplicate removal, chat formatting,
toxicity, sharding, page text, URL rules, document fingerprints, language
identification and benchmark decontamination.

Nothing outside this subpackage imports it."""
