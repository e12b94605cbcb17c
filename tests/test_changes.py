import random
from datetime import datetime, timedelta

import pytest

from siltstone.operators.changes import Manifest, changes_by_run, process_new

T = datetime(2031, 1, 1)
STATES = "namespace string, relative_path string, hash string, size bigint, mod_time_ns bigint, run_no int, recorded_at timestamp"
SNAPSHOTS = "path string, namespace string, run_no int, status string, updated_at timestamp"


def brute(states, reports):
    ok = {}
    for _, n, r, s, t in sorted(reports, key=lambda x: (x[4], x[3] == "indexed")):
        ok[n, r] = s == "indexed"
    last = {}
    for n, p, h, _, _, r, t in states:
        if p is None or n is None:
            continue
        p = p.replace("\\", "/")
        while p.startswith("./"):
            p = p[2:]
        h = h.strip().lower().removeprefix("sha256:") if h else None
        if (n, p, r) not in last or (t, h or "") > (last[n, p, r][0], last[n, p, r][1] or ""):
            last[n, p, r] = (t, h)
    out = set()
    for n in {k[0] for k in ok}:
        left, seen = {}, False
        paths = {p for m, p, _ in last if m == n}
        for r in sorted(r for m, r in ok if m == n):
            now = {p: last[n, p, r][1] for p in paths if (n, p, r) in last}
            if seen:
                out |= {(n, r, p) for p in now if now[p] and now[p] != left.get(p)} | {(n, r, p) for p in left if p not in now}
            if ok[n, r]:
                left = {p: h or left.get(p) for p, h in now.items() if h or p in left}
                seen = True
    return out


def test_against_brute_force(spark):
    r = random.Random(1)
    reports = [("/p", f"n{n}", run, r.choice(["indexing", "indexed", "failed"]), T + timedelta(minutes=r.randint(0, 50))) for n in range(4) for run in range(1, 6) for _ in range(r.randint(1, 3))]
    states = []
    for n in range(4):
        for run in range(1, 6):
            for p in range(8):
                if r.random() < 0.75:
                    h = r.choice(["aa", "bb", "AA", "sha256:bb", None])
                    rows = [(f"n{n}", r.choice(["d/f%d", "d\\f%d", "./d/f%d"]) % p, h, 1, 1, run, T + timedelta(seconds=r.randint(0, 5)))]
                    states += rows * r.randint(1, 2)
    states += [(None, "x", "a", 1, 1, 1, T), ("n0", None, "a", 1, 1, 1, T)]
    got = changes_by_run(spark.createDataFrame(states, STATES), spark.createDataFrame(reports, SNAPSHOTS)).collect()
    assert len(got) == len({(x[0], x[1], x[2]) for x in got})
    assert {(x["namespace"], x["run_no"], x["relative_path"]) for x in got} == brute(states, reports)


def test_empty(spark):
    assert changes_by_run(spark.createDataFrame([], STATES), spark.createDataFrame([], SNAPSHOTS)).count() == 0


def test_manifest_survives_failures(spark, tmp_path):
    f = "relative_path string, size bigint, checksum string"
    listing = spark.createDataFrame([("a", 1, "x"), ("./b", 2, "SHA256:Y"), ("b", 2, "y"), ("c", 3, None)], f)
    root, out = str(tmp_path / "m"), str(tmp_path / "out")
    with pytest.raises(ZeroDivisionError):
        process_new(spark, listing, root, out, lambda p: 1 / 0)
    m = Manifest(spark, root)
    m.write(m.pending(listing), out, m.pending(listing))  # written, then lost before the commit
    assert process_new(spark, listing, root, out, lambda p: p) == 2
    assert spark.read.parquet(out).count() == 2
    assert process_new(spark, listing, root, out, lambda p: p) == 0
    later = spark.createDataFrame([("a", 1, "z"), ("c", 3, "q")], f)
    assert process_new(spark, later, root, out, lambda p: p) == 2
    assert {r["relative_path"] for r in m.read().collect()} == {"a", "c"}


F_ = "relative_path string, size bigint, checksum string"


@pytest.mark.parametrize("step", ["begin", "half written", "written", "half committed", "committed"])
def test_each_record_once_after_a_crash_at_any_step(spark, tmp_path, monkeypatch, step):
    """a and b are there, the run breaks off, c arrives and b changes: every file's current record comes once."""
    root, out = str(tmp_path / "m"), str(tmp_path / "out")
    first = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], F_)
    m, made = Manifest(spark, root), lambda p: p.select("relative_path", "checksum")

    class Crash(Exception):
        pass

    def stop(*_):
        raise Crash

    pending = m.pending(first)
    if step == "begin":
        m.begin(out)
    elif step == "half written":
        batch = m.begin(out)
        made(pending).limit(1).write.parquet(f"{out}/batch_id={batch}")
    elif step == "written":
        m.write(made(pending), out, pending)
    else:
        m.write(made(pending), out, pending)
        monkeypatch.setattr(Manifest, "_mark" if step == "half committed" else "recover", stop)
        with pytest.raises(Crash):
            m.commit(pending)
        monkeypatch.undo()
    assert Manifest(spark, root).read().count() == (2 if step == "committed" else 0)
    later = spark.createDataFrame([("a", 1, "x"), ("./b", 2, "z"), ("c", 3, "q")], F_)
    assert process_new(spark, later, root, out, made) == (2 if step == "committed" else 3)
    now = Manifest(spark, root)
    assert sorted((r["relative_path"], r["checksum"]) for r in now.output(out).collect()) == [("a", "x"), ("b", "z"), ("c", "q")]
    assert process_new(spark, later, root, out, made) == 0 and now._names("open") == []
    seen = [(r["relative_path"], r["checksum"]) for r in spark.read.parquet(out).collect()]  # without the manifest: b's superseded row at most
    assert len(seen) == len(set(seen))


def test_a_log_of_commits(spark, tmp_path, monkeypatch):
    from siltstone.operators import changes

    monkeypatch.setattr(changes, "COMPACT_EVERY", 3)
    root, out, want = str(tmp_path / "m"), str(tmp_path / "out"), {}
    for run in range(7):
        want = {f"f{i}": f"{run // (i + 1)}" for i in range(4) if (run + i) % 3}
        listing = spark.createDataFrame([(p, None, c) for p, c in want.items()], F_)
        process_new(spark, listing, root, out, lambda p: p.select("relative_path", "checksum"))
        m = Manifest(spark, root)
        assert {r["relative_path"]: r["checksum"] for r in m.read().collect()} == want
        assert sorted(map(tuple, m.output(out).select("relative_path", "checksum").collect())) == sorted(want.items())
    assert m._numbers("s") == [3, 6] and m.vacuum(out) and sorted(map(tuple, m.output(out).select("relative_path", "checksum").collect())) == sorted(want.items())
    with pytest.raises(ValueError):
        m.write(spark.range(1), out, m.pending(listing))
    assert m.output(out).count() == len(want) and process_new(spark, listing.limit(0), root, out, lambda p: p) == 0 and m.output(out) is None
