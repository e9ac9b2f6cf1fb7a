"""Spark jobs over an archive of recorded-meeting transcripts."""
