"""Plans: whole pipelines composed from operators, plus the query registry."""
