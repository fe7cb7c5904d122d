"""Inputs: tables of text, directory trees of files, the planted corpus."""
