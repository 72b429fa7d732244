"""Readers and writers of histories, symbol tables and question-answer files."""
