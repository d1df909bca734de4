"""Named queries, each a DataFrame plan with an equivalent SQL text."""
