"""Operators over the mail corpus. Nothing outside this folder imports it."""
