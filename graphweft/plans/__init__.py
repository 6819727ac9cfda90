"""The selector language: parser, and compiler to Spark plans."""
