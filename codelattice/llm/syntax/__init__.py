"""Syntax of source files: lexers, grammars and the error-correcting chart parser."""
