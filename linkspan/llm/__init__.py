"""Operators for preparing training text: cleaning, deduplication, tokens, archives and chats."""
