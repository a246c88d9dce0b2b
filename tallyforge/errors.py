"""Errors of the engine, each with a stable code and an HTTP-like status."""

from __future__ import annotations

# Error codes and statuses; anything else is 500.
STATUS = {
    "malformed": 400,
    "plan_untemplated": 400,
    "join_not_colocated": 400,
    "join_template_required": 400,
    "join_key_mismatch": 400,
    "tier_warm": 404,
    "page_unavailable": 409,
    "quorum_unmet": 409,
    "capacity_exceeded": 422,
    "internal": 500,
    "envelope_invalid": 500,
    "arity_mismatch": 500,
    "type_mismatch": 500,
    "shard_hll_mismatch": 500,
    "read_only_mode": 503,
}


class EngineError(Exception):
    """A refusal; ``code`` is stable, the message is for people and never echoes input values."""

    def __init__(self, code: str, message: str, per_shard: list[dict] | None = None):
        super().__init__(message)
        self.code = code
        self.per_shard = per_shard

    @property
    def status(self) -> int:
        return STATUS.get(self.code, 500)


def malformed(message: str) -> EngineError:
    return EngineError("malformed", message)


class ShardError(Exception):
    """What a shard's source raises to say why it does not answer: an HTTP-like status, or a code."""

    def __init__(self, message: str = "", status: int | None = None, code: str | None = None):
        super().__init__(message)
        self.status, self.code = status, code
