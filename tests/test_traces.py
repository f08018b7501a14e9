"""Trace files with their columns in any order, old, short and marked ones."""

from worktide.sources import traces


def test_columns_are_read_by_name(spark, tmp_path):
    one, two, three, four = (tmp_path / f"m{i}" for i in range(4))
    for folder in (one, two, three, four):
        folder.mkdir()
    (one / "chats.csv").write_text("chat,Time,from,summary,kind,extra\nroom1,2024-01-02 10:00:00,ann,\"a, b\",order,zz\nroom2,2024-01-02 11:00:00\n", "utf-8")
    (two / "chats.csv").write_text("﻿time,from,summary,replied_time,chat,kind\n2024-01-03 09:00:00,bob,hi,,room3,msg\n", "utf-8")
    (three / "chats.csv").write_text("time,from\n2023-01-01 08:00:00,old\n", "utf-8")
    (four / "chats.csv").write_text("", "utf-8")
    rows = traces.multi_root(spark, [str(f) for f in (one, two, three, four, tmp_path / "none")], "chats").collect()
    got = sorted((r["_root"], r["time"], r["from"], r["summary"], r["chat"], r["kind"], r["replied_time"]) for r in rows)
    assert got == [
        ("m0", "2024-01-02 10:00:00", "ann", "a, b", "room1", "order", None),
        ("m1", "2024-01-03 09:00:00", "bob", "hi", "room3", "msg", None),
        ("m2", "2023-01-01 08:00:00", "old", None, None, None, None),
    ]
    assert traces.read_csv(spark, [str(tmp_path / "none" / "chats.csv")], "chats").count() == 0
