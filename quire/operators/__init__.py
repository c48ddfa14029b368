"""Relational operators on documents, lines, paragraphs and outlines.

Every frame is keyed by book_id and carries its order in columns; every window and group begins
with book_id, so a pipeline needs one shuffle on it.
"""
