"""Streams of file events: bursts that end by timers, what is open, restarts, and the checkouts' own events."""

import json
import time

import pytest

from sieveline.engine import Engine
from sieveline.sources import checkouts
from sieveline.sources.files import Checkout, Workspace
from sieveline.streaming import events as ev
from tests.test_engine import repo  # noqa: F401

T = "2024-01-01T00:00:{:02d}.000Z"


def put(folder, name, rows):
    (folder / "in").mkdir(exist_ok=True)
    (folder / f"{name}.tmp").write_text("\n".join(json.dumps(dict(zip(("ts", "seq", "event_type", "path", "dest_path", "is_directory"), r))) for r in rows))
    (folder / f"{name}.tmp").rename(folder / "in" / f"{name}.json")


def until(said, seconds=60):
    end = time.monotonic() + seconds
    while not said() and time.monotonic() < end:
        time.sleep(0.05)
    return said()


class Told:
    """Collects bursts, each with the time at which it came; fails as often as it is told to."""

    def __init__(self, fails=0):
        self.bursts, self.at, self.fails = [], [], fails

    def __call__(self, batch, n):
        rows = {(r["path"], r["op"]) for r in batch.collect()}
        if self.fails:
            self.fails -= 1
            raise ValueError(f"not this time: {sorted(rows)}")
        self.bursts.append(rows)
        self.at.append(time.monotonic())


def test_a_burst_is_told_after_the_pause_and_restarts_keep_open_ones(spark, tmp_path):
    put(tmp_path, "a", [(T.format(1), 1, "created", "r/a.py", None, False), (T.format(2), 2, "deleted", "r/a.py", None, False), (T.format(2), 3, "moved", "r/b.py", "out/.git/b.py", False), (T.format(3), 4, "modified", "r/.git/x", None, False), (T.format(4), 5, "modified", "r", None, True)])
    told, source = Told(), ev.event_source(spark, str(tmp_path / "in"))

    def start(update, gap="3 seconds"):
        return ev.watch(source, update, str(tmp_path / "cp"), gap, scopes=["r"])

    w = start(told)
    try:
        assert until(lambda: told.bursts) == [{("r/a.py", "removed"), ("r/b.py", "removed")}]
        assert until(lambda: w.pending == 0) and w.waiting().count() == 0
        # one more edit, and nothing after it
        began = time.monotonic()
        put(tmp_path, "b", [(T.format(20), 6, "modified", "r/c.py", None, False)])
        assert until(lambda: len(told.bursts) == 2) and told.bursts[1] == {("r/c.py", "changed")}
        assert 3 <= told.at[1] - began < 3 + 5  # a pause, and some batches of a busy machine
        # events that keep coming put the end off, and the last operation on a path counts whatever the order
        w.stop(0)
        w = start(told, "25 seconds")
        for n in range(4):
            put(tmp_path, f"c{n}", [(T.format(30 - n), 10 - n, "deleted" if n == 0 else "modified", "r/d.py", None, False), (T.format(30), n, "modified", f"r/e{n}.py", None, False)])
        assert until(lambda: w.pending == 5, 24) and len(told.bursts) == 2  # paths, not events
    finally:
        w.stop(0)
    # an open burst outlives the stream, and a failed update is repeated
    failing = Told(fails=1)
    w = start(failing)
    with pytest.raises(Exception, match="not this time"):
        w.wait(90)
    w = start(failing)
    try:
        assert until(lambda: failing.bursts) == [{("r/d.py", "removed"), *((f"r/e{n}.py", "changed") for n in range(4))}]
        put(tmp_path, "d", [(T.format(40), 1, "modified", "r/z.py", None, False)])
        w.flush()
        assert failing.bursts[1:] == [{("r/z.py", "changed")}] and not w.query.isActive
    finally:
        w.stop()


NAMES = ["a b.py", "100%.py", "café.py", "[slug].ts", "new\nline.py", "q'\"$.js"]


def test_events_of_checkouts(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / ".gitignore").write_text("ignored.py\n")
    (root / "old.py").write_text("1")
    (root / "gone.py").write_text("1")
    told = Told()
    events = checkouts.events(spark, Workspace([Checkout(root, "r")], ["dist/"]), str(tmp_path / "looks"), str(root / "index"), splits=2)
    (root / "old.py").write_text("22")  # after the first look, before the stream
    w = ev.watch(events, told, str(tmp_path / "cp"), "1 second")
    try:
        assert until(lambda: told.bursts) == [{(str(root / "old.py"), "changed")}]
        for folder in ("index", "dist", ".git"):
            (root / folder).mkdir()
            (root / folder / "x.py").write_text("1")
        (root / "ignored.py").write_text("1")
        (root / "gone.py").unlink()
        for n in NAMES:
            (root / "sub" / n).write_text("1")
        want = {(str(root / "gone.py"), "removed"), *((str(root / "sub" / n), "changed") for n in NAMES)}
        assert until(lambda: set().union(*told.bursts[1:]) == want)
    finally:
        w.stop()
    (root / "old.py").write_text("333")  # while nothing watches
    w = ev.watch(events, told, str(tmp_path / "cp"), "1 second")
    try:
        assert until(lambda: told.bursts[-1] == {(str(root / "old.py"), "changed")})
    finally:
        w.stop()
    assert len(list((tmp_path / "looks").glob("*.parquet"))) < 20  # looks that are done with go


def test_an_engine_watches_its_files(spark, repo):  # noqa: F811
    e = Engine(spark, repo, {"embedder": {"dimensions": 64}})
    e.build()
    before = e.store.chunk_count()
    w = e.watch()
    try:
        (repo / "src/late one.py").write_text("def last_edit():\n    return 1\n")
        assert until(lambda: e.store.chunk_count() > before and not e.state.is_in_progress)
        assert "last_edit" in {r["symbol"] for r in e.list().collect()}
    finally:
        w.stop()
