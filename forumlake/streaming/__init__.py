"""Streams: ingestion of new rows, token streams of models, and the history of chats."""
