"""Operators of a training-data pipeline: tokens, mixing, duplicates, shards, languages, archives, chats and secrets."""
