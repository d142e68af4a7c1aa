"""A backend and a page reader for the command line's tests."""

import json

from ledgerloom.inference import Answer
from ledgerloom.sources.files import register_reader


def answer(prompt, tokens):
    if "Balance Sheet" in prompt:
        return Answer(json.dumps({"entity": {"name": "E", "period_end": "2023-12-31"}, "assets": {"sections": [{"section_name": "Cash", "accounts": [{"account_name": "a", "balance": 5}], "section_total": 5}], "total_assets": 5}}), "stop", 1, 1)
    return Answer("sorry", "stop", 1, 1)


def pages(content):
    if content == b"bad":
        raise ValueError("unreadable")
    return [(i + 1, t, None, None) for i, t in enumerate(content.decode().split("\f"))]


register_reader("stub-pages", pages)
