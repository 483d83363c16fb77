"""Parsed rows leave a task in small frames."""

import pandas as pd

from sieveline.functions import parsers


def test_parsed_rows_leave_in_small_frames(monkeypatch):
    got = {}
    monkeypatch.setattr(parsers, "FRAME_ROWS", 10)

    class Files:
        columns = ("path", "content")

        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            got["frames"] = list(run(iter([pd.DataFrame({"path": [f"a{i}.py" for i in range(50)] + ["x.txt"], "content": ["def f():\n    return g()\n"] * 50 + [None]})] * 2)))

    parsers.facts(Files())
    sizes = [len(f) for f in got["frames"]]
    each = sum(sizes) // 100
    assert sum(sizes) == 100 * each > 0 and max(sizes) < 10 + each and len(sizes) > 10
