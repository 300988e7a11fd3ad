"""Column-level building blocks: text, dates, similarity, scores, patterns."""
