"""A service of messages, newest first: a key is the path of a JSON file and a name in it, so every process sees the same."""

import json
from pathlib import Path


def fetch(key, before, size):
    path, _, name = key.partition("#")
    rows = sorted(json.loads(Path(path).read_text())[name], key=lambda m: -int(m["id"]))
    return [m for m in rows if before is None or int(m["id"]) < int(before)][:size]
