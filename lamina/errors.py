"""Failures with their exit codes."""

from __future__ import annotations


class LaminaError(Exception):
    exit_code = 2


class UsageError(LaminaError):
    exit_code = 2


class CorruptPayload(LaminaError):
    exit_code = 10


class UnsupportedVersion(LaminaError):
    exit_code = 11


class MissingResource(LaminaError):
    exit_code = 12


class HashMismatch(LaminaError):
    exit_code = 13
