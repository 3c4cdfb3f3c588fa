"""Column builders and the HTML parser."""
