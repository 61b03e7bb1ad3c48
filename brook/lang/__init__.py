"""Text to syntax tree: lexer, nodes and parser of the FROM-first pipeline language."""
