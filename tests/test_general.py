"""Orphan references, drifting schemas and timestamps on small cases, skewed keys included."""

import json
from datetime import UTC, datetime

from grainfold.operators import drift, instants, orphans


def run_orphans(spark, refs, events):
    r = spark.createDataFrame(refs, "ref_table string, ref_id bigint, ref_pos int, key string, at bigint")
    e = spark.createDataFrame(events, "key string, at bigint, alive boolean")
    return sorted((x.ref_id, x.ref_pos) for x in orphans.orphans(r, e).collect())


def test_orphans_by_instant(spark):
    events = [("a", 10, True), ("a", 20, False), ("a", 30, True), ("b", 5, True), (None, 1, True), ("c", None, True), ("d", 7, True), ("d", 7, False)]
    refs = [("t", i, 0, k, at) for i, (k, at) in enumerate([("a", 9), ("a", 10), ("a", 19), ("a", 20), ("a", 29), ("a", 30), ("b", 4), ("b", 5), ("c", 50), ("x", 50), (None, 50), ("a", None), ("d", 8), ("a", 9)])]
    assert run_orphans(spark, refs, events) == [(i, 0) for i in (0, 3, 4, 6, 8, 9, 10, 12, 13)]


def test_orphans_of_a_hot_key(spark):
    events = [("hot", i * 10, i % 2 == 0) for i in range(500)] + [(f"k{i}", 0, True) for i in range(300)]
    refs = [("t", i, 0, "hot" if i % 3 else f"k{i % 400}", i % 5000) for i in range(6000)]
    want = [(i, 0) for _, i, _, k, at in refs if (k == "hot" and (at // 10) % 2) or (k != "hot" and int(k[1:]) >= 300)]
    assert run_orphans(spark, refs, events) == sorted(want)


def test_orphans_of_empty_tables(spark):
    assert run_orphans(spark, [], [("a", 1, True)]) == []
    assert run_orphans(spark, [("t", 1, 0, "a", 5)], []) == [(1, 0)]


def changes(spark, rows):
    df = spark.createDataFrame([(i, f, n, x if isinstance(x, str) or x is None else json.dumps(x), "clash") for i, (f, n, x) in enumerate(rows)], "raw_id bigint, feed_id string, file_no int, raw_json string, feed string")
    return {tuple(r) for r in drift.changes(df).collect()}, df


def test_schema_changes(spark):
    rec = lambda c, **k: {"concept": c, **k}
    rows = [("f", 1, rec(c, title=c * 2, old=[c], s=[{"id": c, "n": 1}], gone=1, same="x")) for c in "abc"]
    rows += [("f", 3, rec(c, title={"v": c}, new=[c], s=[{"id": c, "N": 1.0}], come=None, same="x")) for c in "abc"]
    rows += [("f", 3, "{broken"), ("f", 3, "NaN"), ("f", 3, None), ("f", 3, rec("a", title={"v": "a"}, new=["a"], s=[{"id": "a", "N": 1.0}], same="x"))]
    rows += [("g", 1, rec("a", x=1)), ("g", 2, rec("a", y=1)), ("h", 1, "no json"), ("h", 2, rec("a"))]
    found, df = changes(spark, rows)
    assert found == {
        ("f", 3, "title", "retyped", ""), ("f", 3, "old", "renamed", "new"), ("f", 3, "s[].n", "renamed", "s[].N"), ("f", 3, "gone", "removed", ""),
        ("g", 2, "x", "removed", ""), ("g", 2, "y", "added", ""), ("h", 2, "concept", "added", ""),
    }
    table = {r.raw_id: json.loads(r.record) for r in drift.unified(df, drift.changes(df)).collect()}
    assert table[0]["new"] == ["a"] and table[0]["s"] == [{"id": "a", "N": 1}] and "old" not in table[0]


def tabled(spark, rows, **options):
    df = spark.createDataFrame([(i, f, n, json.dumps(x)) for i, (f, n, x) in enumerate(rows)], "raw_id bigint, feed_id string, file_no int, raw_json string")
    return {r.raw_id: json.loads(r.record) for r in drift.unified(df, drift.changes(df, **options)).collect()}


def test_table_has_one_form_at_every_depth(spark):
    rows = [("f", 1, {"concept": c, "sources": [f"/{c}"], "at": {"when": 5}, "status": "x", "by": "me"}) for c in "ab"]
    rows += [("f", 2, {"concept": c, "sources": [{"id": "s0", "href": f"/{c}"}, f"/{c}{c}"], "at": {"when": "5 May"}, "status": True, "by": "me"}) for c in "ab"]
    rows += [("g", 1, {"concept": "z", "sources": "/z", "status": [["y"], "v"], "by": {"name": "me", "more": {"n": 1}}}), ("g", 1, {"concept": "y", "sources": [], "by": {"more": 2}})]
    table = tabled(spark, rows)
    assert table[0] == {"concept": "a", "sources": [{"href": "/a"}], "at": {"when": "5"}, "status": [["x"]], "by": {"value": "me"}}
    assert table[2] == {"concept": "a", "sources": [{"id": "s0", "href": "/a"}, {"href": "/aa"}], "at": {"when": "5 May"}, "status": [["true"]], "by": {"value": "me"}}
    assert table[4] == {"concept": "z", "sources": [{"href": "/z"}], "status": [["y"], ["v"]], "by": {"name": "me", "more": {"n": 1}}}
    assert table[5] == {"concept": "y", "sources": [], "by": {"more": {"value": 2}}}


def test_table_with_typed_columns(spark):
    rows = [("f", 1, {"concept": "a", "n": 1, "s": "x", "at": {"by": "me"}}), ("f", 2, {"concept": "a", "n": 2.5, "s": ["y", "z"], "at": "now"}), ("g", 1, {"concept": "b", "flag": True})]
    df = spark.createDataFrame([(i, f, n, json.dumps(x)) for i, (f, n, x) in enumerate(rows)], "raw_id bigint, feed_id string, file_no int, raw_json string")
    got = drift.typed(drift.unified(df, drift.changes(df)))
    assert got.schema["record"].dataType.simpleString() == "struct<at:struct<by:string,value:string>,concept:string,flag:boolean,n:double,s:array<string>>"
    assert {r.raw_id: (r.feed_id, r.file_no, r.record.n, r.record.s, r.record.flag) for r in got.collect()} == {0: ("f", 1, 1.0, ["x"], None), 1: ("f", 2, 2.5, ["y", "z"], None), 2: ("g", 1, None, None, True)}
    assert drift.typed(drift.unified(df.where("false"), drift.changes(df.where("false")))).collect() == []


def test_table_keeps_what_a_rename_meets(spark):
    rows = [("f", 1, {"concept": c, "a": {"x": c}, "q": 7}) for c in "ab"] + [("f", 2, {"concept": c, "b": {"x": c}, "p": 7}) for c in "ab"]
    rows += [("f", 3, {"concept": c, "b": {"y": c}, "p": 7}) for c in "ab"] + [("f", 4, {"concept": c, "b": {"y": c}, "q": 7}) for c in "ab"]
    assert all(r == {"concept": r["concept"], "b": {"y": r["concept"]}, "q": 7} for r in tabled(spark, rows).values())


def test_table_follows_moves(spark):
    rows = [("f", 1, {"concept": c, "timestamp": f"{c}1", "s": [{"u": f"{c}2"}], "meta": {"k": f"{c}3", "old": f"{c}4"}}) for c in "abc"]
    rows += [("f", 2, {"concept": c, "generated": {"at": f"{c}1", "by": "me"}, "s": [{"v": {"w": f"{c}2"}}], "info": {"k": f"{c}3", "new": f"{c}4"}}) for c in "abc"]
    rows += [("f", 3, {"concept": c, "generated": {"by": "me"}, "at": f"{c}1", "s": [{"v": {"w": f"{c}2"}}], "info": {"k": f"{c}3", "new": f"{c}4"}}) for c in "abc"]
    table = tabled(spark, rows, moving=True)
    assert table[0] == {"concept": "a", "at": "a1", "s": [{"v": {"w": "a2"}}], "info": {"k": "a3", "new": "a4"}}
    assert table[3] == table[6] == {"concept": "a", "at": "a1", "generated": {"by": "me"}, "s": [{"v": {"w": "a2"}}], "info": {"k": "a3", "new": "a4"}}
    assert "moved" not in {kind for _, _, _, kind, _ in changes(spark, rows)[0]}


def test_table_does_not_move_onto_what_is_there(spark):
    rows = [("f", 1, {"concept": c, "x": c * 2, "g": "plain"}) for c in "ab"] + [("f", 2, {"concept": c, "g": {"x": c * 2}}) for c in "ab"]
    rows += [("f", 1, {"concept": "c", "x": "cc", "g": {"x": "other"}})]
    table = tabled(spark, rows, moving=True)
    assert table[0] == {"concept": "a", "x": "aa", "g": {"value": "plain"}} and table[4] == {"concept": "c", "x": "cc", "g": {"x": "other"}}


def test_schema_changes_of_nothing(spark):
    assert changes(spark, [])[0] == set()


def test_edit_script_is_cheapest():
    old = drift.tree_of([("a", 1), ("b", 8), ("b.x", 1), ("b.y", 1)])
    new = drift.tree_of([("c", 1), ("d", 8), ("d.x", 1), ("d.y", 1)])
    assert drift.edit_script(old, new, {("a", "c"), ("b", "d")}) == [("a", "renamed", "c"), ("b", "renamed", "d")]
    assert sorted(drift.edit_script(old, new, set())) == [("a", "removed", ""), ("b", "removed", ""), ("c", "added", ""), ("d", "added", "")]
    assert drift.assignment([[4, 1, 3], [2, 0, 5], [3, 2, 2]]) == [1, 0, 2]


def resolved(spark, rows, sources):
    v = spark.createDataFrame([("t", i, s, x) for i, (s, x) in enumerate(rows)], "ref_table string, ref_id bigint, source string, value string")
    s = spark.createDataFrame(sources, "source string, zone string, date_order string")
    return {r.ref_id: r for r in instants.instants(v, s).collect()}


def us(*when):
    d = datetime(*when, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return (d.days * 86400 + d.seconds) * 10**6 + d.microseconds


def test_formats_and_zones(spark):
    cases = [
        ("b", "2024-03-31T02:30:00", us(2024, 3, 31, 1, 30)), ("b", "2024-10-27 02:30", us(2024, 10, 27, 0, 30)), ("b", "2024-05-06", us(2024, 5, 5, 22)), ("b", "05.06.2024 10:00", us(2024, 6, 5, 8)), ("b", " 2024-01-01t00:00:00z\n", us(2024, 1, 1)),
        ("n", "07/04/2024 3:46 AM", us(2024, 7, 4, 7, 46)), ("n", "13/04/2024 03:46:00", None), ("b", "13/04/2024 03:46:00", us(2024, 4, 13, 1, 46)), ("n", "2024-03-10 02:30:00", us(2024, 3, 10, 7, 30)), ("b", "Fri, 01 Nov 2024 12:42:22 +0100", us(2024, 11, 1, 11, 42, 22)),
        ("b", "1 April 2023, 12:22", us(2023, 4, 1, 10, 22)), ("n", "Apr 10, 2024 2:42 PM", us(2024, 4, 10, 18, 42)), ("b", "2024-01-01 10:00:00 EST", us(2024, 1, 1, 15)), ("b", "1700000000", 1700000000000000), ("b", "1700000000123", 1700000000123000), ("b", "1700000000123456", 1700000000123456),
        ("b", "2024-01-01T00:00:00.123456789Z", us(2024, 1, 1, 0, 0, 0, 123456)), ("b", "20240101T000000Z", us(2024, 1, 1)), ("b", "2024-01-01T05:45:00+05:45[Asia/Kathmandu]", us(2024, 1, 1)), ("b", "2024-02-30", None), ("b", "0000-00-00", None), ("b", "25:61", None), ("b", "Q3 2024", None), ("b", "2024-01-01 24:00:00", None), ("b", "2024-01-01 10:00:60", None), ("b", "", None), ("b", None, None), ("x", "2024-01-01 10:00", None), ("x", "2024-01-01T10:00:00Z", us(2024, 1, 1, 10)),
        ("b", "12:00", None), ("b", "2024-01-01 10:00 FOO", None), ("b", "Jan 5, 2024 12:10 AM", us(2024, 1, 4, 23, 10)),
    ]
    found = resolved(spark, [c[:2] for c in cases], [("b", "Europe/Berlin", "dmy"), ("n", "America/New_York", "mdy"), ("x", "Mars/Base", None)])
    assert {i: found[i].utc_us for i in found} == {i: c[2] for i, c in enumerate(cases)}
    assert found[26].status == "missing" and found[22].status == "unreadable" and found[27].status == "ambiguous"


def test_mixture_decides_undeclared_order(spark):
    rows = [("u", f"{d}/03/2024 10:00:00") for d in range(13, 29)] * 3 + [("u", "04/05/2024 10:00:00"), ("v", "04/05/2024 10:00:00"), ("v", "04/04/2024 10:00:00")]
    found = resolved(spark, rows, [("u", "UTC", None), ("v", "UTC", None)])
    assert found[48].utc_us == us(2024, 5, 4, 10) and found[48].posterior > 0.9
    assert found[49].status == "ambiguous" and found[50].utc_us == us(2024, 4, 4, 10)


def test_mixture_weighs_declarations(spark):
    # A declared order holds for dates that fit both, few dates against it are doubtful, many overrule it.
    few = [("few", "04/05/2024"), ("few", "13/05/2024")] + [("few", f"05/{d}/2024") for d in range(13, 29)]
    many = [("many", f"{d}/05/2024") for d in range(13, 32)] * 700 + [("many", "04/05/2024"), ("many", "25/12/2023")]
    found = resolved(spark, few + many, [("few", "UTC", "mdy"), ("many", "UTC", "mdy")])
    assert found[0].utc_us == us(2024, 4, 5) and (found[1].status, found[1].format) == ("ambiguous", "misprint")
    assert found[len(few)].utc_us == us(2024, 5, 13) and found[len(few + many) - 1].utc_us == us(2023, 12, 25) and found[len(few + many) - 2].utc_us == us(2024, 5, 4)


def test_mixture_marks_unknown_zones_and_units(spark):
    rows = [("z", "2024-01-01 10:00"), ("z", "2024-01-01T10:00Z"), (None, "2024-01-01 10:00"), (None, "2024-01-01T10:00Z"), ("e", "99999999999")] + [("ms", str(10**12 + k)) for k in range(99)] + [("ms", "99999999999")]
    found = resolved(spark, rows, [("z", None, None), ("e", "UTC", None), ("ms", "UTC", None)])
    assert [found[k].status for k in range(5)] == ["ambiguous", "resolved", "ambiguous", "resolved", "ambiguous"]
    assert found[104].utc_us == 99999999999 * 1000 and found[104].format == "epoch_ms"


def test_instants_with_further_columns_and_repeated_sources(spark):
    v = spark.createDataFrame([("t", 1, "a", "2024-01-01 10:00", "x", "y", "z")] * 2, "ref_table string, ref_id bigint, source string, value string, zone string, found string, posterior string")
    s = spark.createDataFrame([("a", "Europe/Berlin", "DMY", "x")] * 2, "source string, zone string, date_order string, value string")
    assert [(r.utc_us, r.status) for r in instants.instants(v, s).collect()] == [(us(2024, 1, 1, 9), "resolved")] * 2


def test_instants_of_nothing(spark):
    assert resolved(spark, [], [("a", "UTC", None)]) == {} and resolved(spark, [("a", "2024-01-01T00:00Z")], [])[0].utc_us == us(2024, 1, 1)
