"""Operators over corpora and entity groups; nothing outside this subpackage imports it."""
