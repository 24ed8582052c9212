import random

from paperloom.llm import conversations as C

U = "c0000000-0000-0000-0000-00000000000"


def rows(*turns, conv=U + "1", start=1_700_000_000):
    return [(f"{conv[-2:]}m{i:04d}", conv, role, text, start + 10 * i) for i, (role, text) in enumerate(turns)]


def frame(spark, data):
    return spark.createDataFrame([(*r, None, "x") for r in data], "id string, conversation_id string, role string, content string, timestamp long, sources string, conv string").drop("conv")


def heads(spark, *ids):
    return spark.createDataFrame([(i, "t") for i in ids], "id string, title string")


def test_reasons(spark):
    data = rows(("user", "a"), ("assistant", "b"))
    data += rows(("user", " "), ("assistant", "..."), conv=U + "2")
    data += rows(("assistant", "a"), ("user", "b"), ("assistant", "c"), conv=U + "3")
    data += rows(("user", "a"), ("Bot", "b"), ("AI", "c"), conv=U + "4")
    data += rows(("user", "a"), ("user", "b"), ("assistant", "c"), conv=U + "5")
    data += rows(("user", "a"), ("assistant", "—"), conv=U + "6")
    data += rows(("?", "a"), ("assistant", "b"), conv=U + "7")
    data += rows(("user", "a"), ("assistant", "b"), conv=U + "8")  # no row in conversations
    data += rows(("system", "be nice"), ("HUMAN ", "a"), (" assistant", "b"), conv="  " + U.upper() + "9 ")
    data += [("lost", None, "user", "x", 1), (None, U + "1", "system", None, 2)]
    data += data[:3]
    convs = heads(spark, *(U + str(i) for i in (1, 2, 3, 4, 5, 6, 7, 9)), U + "a", U + "1")
    got = {tuple(r) for r in C.found(convs, frame(spark, data)).collect()}
    assert got == {(U + "2", "empty"), (U + "3", "broken"), (U + "4", "broken"), (U + "5", "missing_reply"), (U + "6", "missing_reply"), (U + "7", "broken"), (U + "8", "broken"), (U + "a", "empty")}


def test_units_and_ties(spark):
    data = [("b", U + "1", "user", "q", 1_700_000_000_900), ("a", U + "1", "assistant", "r", 1_700_000_000), ("c", U + "1", "user", "q2", 1_700_000_005), ("d", U + "1", "assistant", "r2", 1_700_000_005_000)]
    convs = heads(spark, U + "1")
    assert C.found(convs, frame(spark, data)).count() == 0
    out = C.turns(convs, frame(spark, data)).orderBy("position").collect()
    assert [r.content for r in out] == ["q", "r", "q2", "r2"] and [r.position for r in out] == [0, 1, 2, 3]


def test_long_conversation_is_cut_and_put_together(spark):
    turns = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(2500)]
    data = rows(*turns)
    random.Random(1).shuffle(data)
    convs = heads(spark, U + "1")
    messages = frame(spark, data)
    assert C.fragments(messages).count() > 3
    assert C.found(convs, messages).count() == 0
    out = C.turns(convs, messages).orderBy("position").collect()
    assert [r.content for r in out] == [t for _, t in turns]
    broken = messages.where("id != '-1m1001' and content != 't1001'")
    assert [r.reason for r in C.found(convs, broken).collect()] == ["missing_reply"]


def test_assembly_of_exports(spark):
    parts = spark.createDataFrame(
        [("x", 0, [1, 2, 3, 4]), ("x", 1, [3, 4, 5]), ("x", 2, [5, 6]), ("x", 3, [4, 5]), ("gap", 0, [1, 2]), ("gap", 1, [4, 5]), ("fork", 0, [1, 2]), ("fork", 1, [2, 3]), ("fork", 2, [2, 4]), ("one", 0, [9])],
        "conv string, fragment long, hashes array<long>",
    )
    got = {(r.conv, r.fragment): (r.root, r.start) for r in C.assemble(parts).collect()}
    assert got[("x", 0)] == (0, 0) and got[("x", 1)] == (0, 2) and got[("x", 2)] == (0, 4) and ("x", 3) not in got
    assert got[("gap", 0)][0] != got[("gap", 1)][0]
    assert len({got[("fork", f)][0] for f in range(3)}) == 3
    assert got[("one", 0)] == (0, 0)


def test_empty_tables(spark):
    convs, messages = heads(spark, U + "1"), frame(spark, rows(("user", "a")))
    assert [tuple(r) for r in C.found(convs, messages.limit(0)).collect()] == [(U + "1", "empty")]
    assert [tuple(r) for r in C.found(convs.limit(0), messages).collect()] == [(U + "1", "broken")]


def test_one_bad_time_leaves_the_fragments_short(spark):
    turns = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(3001)]
    data = rows(*turns)
    data[0] = (*data[0][:4], None)
    parts = C.fragments(frame(spark, data)).collect()
    assert max(r.own for r in parts) <= C.FRAGMENT and sum(r.own for r in parts) == 3001
    same = [(*r[:4], 5) for r in data]
    assert max(r.own for r in C.fragments(frame(spark, same)).collect()) <= C.FRAGMENT


def test_a_last_fragment_of_one_message_is_kept(spark):
    turns = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(C.FRAGMENT * 2 + 1)] + [("assistant", " ")]
    data = rows(*turns[:-1])
    convs = heads(spark, U + "1")
    assert [r.reason for r in C.found(convs, frame(spark, data)).collect()] == ["missing_reply"]
    data += [("-1x", U + "1", "assistant", "end", 1_800_000_000)]
    out = C.turns(convs, frame(spark, data)).orderBy("position").collect()
    assert [r.content for r in out] == [t for _, t in turns[:-1]] + ["end"] and [r.position for r in out] == list(range(len(out)))
    long = data + [("-1y", U + "1", "user", "more", 1_800_000_001), ("-1z", U + "1", "assistant", "yes", 1_800_000_002)]
    one_over = [r for r in long if r[0] != "-1m0000"][1:]
    assert len(C.turns(convs, frame(spark, one_over)).collect()) in (0, len(one_over))


def test_messages_without_an_id_keep_their_text(spark):
    data = [(None, U + "1", "user", "q", 1), (None, U + "1", "assistant", "r", 2), ("a", U + "2", "user", "x", 1), ("a2", U + "2", "assistant", "y", 3), ("a", U + "3", "user", "other", 1), ("a3", U + "3", "assistant", "z", 3)]
    out = C.turns(heads(spark, U + "1", U + "2", U + "3"), frame(spark, data)).collect()
    assert {(r.conversation_id[-1], r.content) for r in out} == {("1", "q"), ("1", "r"), ("2", "x"), ("2", "y"), ("3", "other"), ("3", "z")}


def test_without_assembly_long_conversations_are_broken(spark, monkeypatch):
    data = rows(*[("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(1000)])
    monkeypatch.setattr(C, "assemble", lambda parts: parts.selectExpr("conv", "fragment", "fragment as root", "0L as start"))
    assert [r.reason for r in C.found(heads(spark, U + "1"), frame(spark, data)).collect()] == ["broken"]


def exported(spark, *parts):
    """Rows in one partition, export after export: places of messages of a conversation."""
    turn = lambda i: (f"m{i:04d}", U + "1", "user" if i % 2 == 0 else "assistant", f"t{i}", 1_700_000_000 + 10 * i)
    return frame(spark, [turn(i) for part in parts for i in part]).coalesce(1)


def test_exports_are_found_in_the_order_of_arrival(spark):
    messages = exported(spark, range(4), range(2, 8), [5, 6, 7], [7, 8, 9])
    got = sorted((r.export, [t.mid for t in r.turns]) for r in C.exports(messages).collect())
    assert [[int(m[1:]) for m in mids] for _, mids in got] == [[0, 1, 2, 3], [2, 3, 4, 5, 6, 7], [5, 6, 7], [7, 8, 9]]
    out = C.turns(heads(spark, U + "1"), messages).orderBy("position").collect()
    assert [(r.position, r.content) for r in out] == [(i, f"t{i}") for i in range(10)]


def test_the_path_of_the_exports_decides_the_order(spark, monkeypatch):
    messages = exported(spark, range(4), range(2, 8))
    assert {r.key for r in C.woven(C.exports(messages)).collect()} == set(range(8))
    real = C.assemble

    def turned(parts):
        """The later export first."""
        out = real(parts)
        return out.withColumn("start", 2 - out["start"])

    monkeypatch.setattr(C, "assemble", turned)
    out = C.turns(heads(spark, U + "1"), messages).orderBy("position").collect()
    assert [r.content for r in out] != [f"t{i}" for i in range(8)]


def test_exports_without_an_overlap_are_woven_by_time(spark):
    late = exported(spark, [0, 1, 2, 5, 6, 7], [3, 4], [1, 6, 7], [4, 5])
    assert {r.key for r in C.woven(C.exports(late)).collect()} == {1_700_000_000 + 10 * i for i in range(8)}
    convs = heads(spark, U + "1")
    assert C.found(convs, late).count() == 0
    assert [r.content for r in C.turns(convs, late).orderBy("position").collect()] == [f"t{i}" for i in range(8)]


def test_exports_of_a_long_conversation_are_put_together(spark):
    n = 2 * C.FRAGMENT + 300
    messages = exported(spark, range(C.FRAGMENT + 50), range(C.FRAGMENT - 20, n), range(n - 10, n + 100), [7])
    arrived = C.exports(messages)
    assert max(len(r.turns) for r in arrived.collect()) <= C.FRAGMENT + 1
    keys = {r.key for r in C.woven(arrived).collect()}
    assert keys == set(range(n + 100))
    convs = heads(spark, U + "1")
    assert C.found(convs, messages).count() == 0
    assert [r.content for r in C.turns(convs, messages).orderBy("position").collect()] == [f"t{i}" for i in range(n + 100)]
    assert C.assemble(arrived.selectExpr("conv", "export as fragment", "transform(turns, t -> t.hash) as hashes")).select("root").distinct().count() == 1
