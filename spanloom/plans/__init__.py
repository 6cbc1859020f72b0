"""Registered queries over the test tables, each with its SQL check."""

from . import agents_q, audit_q, builders_q, env_q, evals_q, functions_q, generate_q, io_q, runs_q, select_q, sequence_q, spans_q, stream_q, text_q, traces_q  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
