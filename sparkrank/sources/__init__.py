"""Readers and writers of the upstream documents, the panel and squads."""
