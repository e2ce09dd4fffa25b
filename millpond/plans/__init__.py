"""Gold models, metrics and operational analytics, one function per model."""
