"""Statements as typed trees: lexer, nodes and parser."""
