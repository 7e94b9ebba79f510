"""Moves of files: runs that stop go on, nothing is lost or doubled."""

import pytest

from mulberry.operators import moves as m


@pytest.fixture
def files(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(40):
        (folder / f"f {i}% #.txt").write_text(str(i))
    return folder


def plan_of(spark, folder, n=40):
    return spark.createDataFrame([(i, f"file:{folder}/f {i}% #.txt", f"{folder}/../out/{i % 5}/새 {i}.txt".replace("/in/..", "")) for i in range(n)], "seq long, old_path string, new_path string")


def contents(folder):
    return sorted(int(p.read_text()) for p in folder.rglob("*.txt"))


def test_a_killed_run_goes_on(spark, files, tmp_path):
    plan, log = plan_of(spark, files), f"{tmp_path}/log"
    for i in range(0, 40, 3):  # what a killed run had done without a log
        old, new = plan.filter(f"seq = {i}").select("old_path", "new_path").first()
        assert m._move(old, new) == ("moved", None)
    got = {r.seq: r.status for r in m.carry_out(plan, log, "a").collect()}
    assert got == {i: "moved" if i % 3 else "done before" for i in range(40)}
    assert contents(tmp_path) == list(range(40)) and not list(files.iterdir())
    assert {r.status for r in m.carry_out(plan, log, "a").collect()} == {"done before"}
    assert m.read_log(spark, log).count() == 40
    undone = m.carry_out(m.undo_plan(m.read_log(spark, log)), log, "undo")
    assert {r.status for r in undone.collect()} == {"moved"} and contents(files) == list(range(40))


def test_steps_that_can_t_be_done(spark, files, tmp_path):
    (tmp_path / "taken.txt").write_text("1000")
    f = f"{files}/f "
    rows = [(1, f"{f}1% #.txt", f"{tmp_path}/taken.txt"), (2, f"{f}2% #.txt", f"{tmp_path}/two.txt"), (3, f"{f}3% #.txt", f"{tmp_path}/two.txt"), (4, f"{f}4% #.txt", f"{f}4% #.txt"), (5, None, "x"), (6, f"{tmp_path}/gone", f"{tmp_path}/g"), (7, f"{f}7% #.txt", "nosuch://a/b")]
    rows += [(8, f"{f}8% #.txt", f"{f}9% #.txt"), (9, f"{f}9% #.txt", f"{tmp_path}/nine.txt")]
    plan = spark.createDataFrame(rows, "seq long, old_path string, new_path string").coalesce(1)
    got = {r.seq: r.status for r in m.carry_out(plan, f"{tmp_path}/log", "a").collect()}
    assert got | {8: None} == {1: "blocked", 2: "moved", 3: "blocked", 4: "skipped", 5: "skipped", 6: "missing", 7: "failed", 8: None, 9: "moved"}
    got = {r.seq: r.status for r in m.carry_out(plan, f"{tmp_path}/log", "b").collect()}
    assert got[8] in ("moved", "done before") and (files / "f 9% #.txt").read_text() == "8" and (tmp_path / "nine.txt").read_text() == "9"
    assert contents(tmp_path) == sorted([*range(40), 1000])
