"""Column builders: identity, tokens, filters, similarity and guards."""
