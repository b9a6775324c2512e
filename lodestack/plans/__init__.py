"""Registered queries."""

from . import corpus, text, usage

PLANS = (text, corpus, usage)
