"""Training-data operators over documents, pages, conversations and media columns.

Nothing outside this subpackage imports it.
"""
