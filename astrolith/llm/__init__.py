"""Operators for a training corpus. Nothing outside this subpackage imports it."""
