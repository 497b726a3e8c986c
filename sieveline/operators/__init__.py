"""Index, screening, benchmark generation, evaluation, adjudication rules."""
