"""Registered queries over the supplied tables, each with its SQL answer where SQL can express it."""
