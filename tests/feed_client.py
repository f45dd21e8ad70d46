"""A feed for the tests: a file of JSON lines for each market, oldest first."""

import json
from pathlib import Path


class Folder:
    def __init__(self, options):
        self.path = Path(options["folder"])

    def markets(self):
        return sorted(p.stem for p in self.path.glob("*.jsonl"))

    def newest(self, market, offset, limit):
        rows = [json.loads(x) for x in (self.path / f"{market}.jsonl").read_text().splitlines()][::-1]
        return rows[offset : offset + limit]
