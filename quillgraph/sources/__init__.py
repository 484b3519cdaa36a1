"""Readers and writers for documents, chunks, graph records, questions and logs."""
