"""docloom.operators."""
