"""Part of the tallymark engine."""
