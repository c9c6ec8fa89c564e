"""Operators of a training-data pipeline: language, sharding, decontamination, near copies, tokens, archives,
mixtures, repeated spans and vector search.  One module per operator; ``queries`` registers them."""
