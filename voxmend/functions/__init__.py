"""Column expressions: text, phonetics, distances, edits, prompts, model replies."""
