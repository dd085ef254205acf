"""Scalar expressions and document functions on small values."""

import pytest
from pyspark.sql import functions as F

from grainfold.functions import frontmatter as fm
from grainfold.functions import links, paths, text


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'bigint'}" for k, v in values.items())).select(expression).first()[0]


@pytest.mark.parametrize(
    ("target", "directory", "concept"),
    [
        ("/a/b.md", "x", "a/b"), ("b.md", "a", "a/b"), ("../b.md", "a/c", "a/b"), ("/wiki/a/b.md", "", "a/b"), ("<a b.md>", "", "a b"), (" <../b.md> ", "a", "b"), ("b.md#part", "a", "a/b"), ("b.md?x=1#y", "a", "a/b"), ("b%20c.md", "a", "a/b c"), ("a+b.md", "", "a+b"), ("b%zz.md", "a", "a/b%zz"), ("b%FF.md", "a", "a/b%FF"),
        ("https://x.invalid/a.md", "a", None), ("mailto:x", "", None), ("../../b.md", "a", None), ("b.txt", "a", None), ("", "a", None), ("#x", "a", None), (None, "a", None), ("./a//b.md", "", "a/b"),
    ],
)
def test_concept_of_link(spark, target, directory, concept):
    from grainfold.functions.links import resolve

    assert one(spark, paths.concept_of_link(F.col("t"), F.col("d")), t=target, d=directory) == concept
    if target is not None:
        assert resolve(target, directory) == concept


@pytest.mark.parametrize(("n", "name"), [(1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA")])
def test_column_name(spark, n, name):
    assert one(spark, text.column_name(F.col("n")), n=n) == name


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="Ab abc ÜBER über_x1 abc 12 123") == ["abc", "über", "über", "abc", "123"]


@pytest.mark.parametrize(("title", "resource", "slug"), [("A Title!", "", "a-title"), (None, "https://x.invalid/a/b-c.html?q", "b-c-html"), (None, "https://x.invalid/", "x-invalid"), ("!!", "", "source"), ("w" * 39 + " x", "", "w" * 39)])
def test_slug(spark, title, resource, slug):
    assert one(spark, text.slug(F.col("t"), F.col("r")), t=title, r=resource) == slug


def test_prose_skips_fences():
    lines = "a\n```\nb\n~~~\n```\nc\n~~~~\nd\n~~~\ne\n~~~~\nf\n``x``".split("\n")
    assert [x for x, shown in zip(lines, links.prose(lines)) if shown] == ["a", "c", "f", "``x``"]


@pytest.mark.parametrize(
    ("line", "targets"),
    [
        ("[a](b.md)", ["b.md"]), ("![a]( <b c> 'T' ) x [d](e \"t\")", ["<b c>", "e"]), ("[a](b (t)) [c]()", ["b", ""]), ("[a](b c) [d](e", []), ("[a](b(c).md)", []), ("[a](b \"t) [c](d)", ["d"]), ("](x)", ["x"]), ("a]( (b))", []),
        ("[a](b (t(u)))", []), ("[a](<b)", []), ("", []),
    ],
)
def test_inline_links(line, targets):
    assert [x.target(line) for x in links.inline_links(line)] == targets


@pytest.mark.parametrize(("line", "target"), [("[a]: b 'T'", "b"), ("   [a b]: <c d> e", "<c d>"), ("    [a]: b", None), ("[]: b", None), ("[a]:", None), ("[a] : b", None), ("x [a]: b", None), ("[a]:b", "b")])
def test_definitions(line, target):
    found = links.definition(line)
    assert (found and found.target(line)) == target


@pytest.mark.parametrize(("line", "item"), [("- a b", "a b"), ("  * [2] a", "a"), ("12) x", "x"), ("[3] [4] x", "[4] x"), ("-a", None), ("a b", None), ("- ", None), ("1.5 x", None), ("", None)])
def test_bullets(line, item):
    assert links.bullet(line) == item


def test_stripped_markup(spark):
    assert one(spark, text.stripped_markup(F.col("t")), t="<p>a<script>x</script> &amp;lt; <!-- c -->b</p>") == "a < b"


def test_code_fence(spark):
    assert one(spark, text.code_fence(F.col("t"), F.lit("py")), t="a ``` b") == "````py\na ``` b\n````"


def test_status_migration(spark):
    assert [one(spark, text.migrated_status(F.col("t")), t=x) for x in (" Current ", "SUPERSEDED", "stable", None)] == ["stable", "deprecated", None, None]


def test_normalised_path(spark):
    assert [one(spark, paths.normalised(F.col("t")), t=x) for x in ("a/./b//c", "a/../b", "..", "/a")] == ["a/b/c", "b", None, "a"]


# Front matter


def head(block):
    return fm.split_document(f"---\n{block}\n---\n\nbody\n")[0]


def test_core_schema_keeps_text():
    assert head("a: 2024-01-01\nb: yes\nc: 012\nd: 12:30:00\ne: 1_000\nf: true\ng: ~\nh: 0x10") == {"a": "2024-01-01", "b": "yes", "c": 12, "d": "12:30:00", "e": "1_000", "f": True, "g": None, "h": 16}


@pytest.mark.parametrize(
    ("block", "key", "value"),
    [("title: a: b: c\ntype: t", "title", "a: b: c"), ("title: *emphasis* here\ntype: t", "title", "*emphasis* here"), ("tags: [*x, b]\ntype: t", "tags", ["*x", "b"]), ("a: &x 1\nb: *x\ntype: t", "b", 1), ("title: ok\nbroken: [a, b\ntype: t", "title", "ok"), ("title: one\ntitle: two\ntype: t", "title", "two")],
)
def test_repairs(block, key, value):
    found = head(block)
    assert found[key] == value and found["type"] == "t"


def test_many_colons():
    found = head("\n".join(f"k{i}: a: b{i}" for i in range(25)))
    assert found["k24"] == "a: b24"


def test_documents_without_front_matter():
    assert fm.split_document("text") == (None, "text")
    assert fm.split_document("---\na: 1\ntext") == (None, "---\na: 1\ntext")
    assert fm.split_document("---\n- a\n---\nbody") == (None, "body")
    assert fm.split_document("---\n# only a comment\n---\nbody") == ({}, "body")
    assert fm.split_document("---\r\na: 1\r\n---\r\nx\r\ny") == ({"a": 1}, "x\ny")


def test_round_trip_keeps_unknown_keys_in_order():
    raw = {"z": 1, "type": "t", "a": {"b": [1, "2024-01-01", "yes"]}, "ü": "é: x"}
    again, body = fm.split_document(fm.serialise(raw, "\n\nbody \n\n"))
    assert list(again.items()) == list(raw.items()) and body == "\nbody\n"


def test_typed_view(spark):
    content = "---\ntype: 3\ntags: one\nverified: {by: 'human:x', at: 2024-01-01}\nsources: [{id: a, usage_count: 2}, 7, {}]\ngenerated: x\nextra: [1]\n---\nbody"
    df = spark.createDataFrame([("a", content), ("b", None), ("c", "")], "id string, content string")
    rows = {r.id: r for r in fm.parse_documents(df, "id", "content").collect()}
    f = rows["a"].frontmatter
    assert (f.type, f.tags, f.verified[0].by, f.generated, len(f.sources), f.sources[0].usage_count) == ("3", ["one"], "human:x", None, 1, 2.0)
    assert '"extra": [1]' in f.raw_json and rows["b"].body is None and rows["c"].body == ""
