"""Readers and writers of transcripts, documents and exports."""
