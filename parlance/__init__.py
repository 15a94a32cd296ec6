"""Part of the speech-annotation engine."""
