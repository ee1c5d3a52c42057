"""Readers and writers of model text, tables and ledgers."""
