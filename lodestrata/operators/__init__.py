"""Relational operators: lexical, dense and graph retrieval as DataFrame plans."""
