"""Readers and writers of the text formats; each reader gives plain tables, each writer takes them."""
