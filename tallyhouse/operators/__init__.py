"""Relational operators, counting operators, graph operators and analytics, all DataFrame in, DataFrame out."""
