"""Employer-record and posting-text analytics expressed as Spark plans."""
