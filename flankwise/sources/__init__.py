"""Readers and writers: FASTA, TSV, JSON, ZIP/XLSX, JATS and their sinks."""
