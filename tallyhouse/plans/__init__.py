"""A small SQL dialect: lexer, parser, compiler to DataFrames, and the facts that its trees tell."""
