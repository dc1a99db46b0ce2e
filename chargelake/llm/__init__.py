"""Operators for preparing language-model training data (documents, chats, binary codes)."""
