"""The pipeline language: text to checked documents."""
