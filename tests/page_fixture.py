"""A service that hands out rows of a file in pages, and fails once in a while."""

import json
import os

PLACE = os.environ.get("PAGED_ROWS", "/tmp/paged-rows.jsonl")


def _rows():
    with open(PLACE) as f:
        return [json.loads(line) for line in f]


def count():
    return len(_rows())


def fetch(offset, limit):
    marker = f"{PLACE}.{offset}"
    if offset % 7 == 0 and not os.path.exists(marker):
        open(marker, "w").close()
        raise OSError("busy")
    return _rows()[offset : offset + min(limit, 4)]


def fails(offset, limit):
    raise OSError("gone")
