"""Part of the code-knowledge engine."""
