"""Knowledge-base, intake, rewriting and pre-pass operators, and the commands end to end."""

import json
import os

from grainfold.operators import intake, retrieval, rewrite, wiki
from grainfold.plans import commands, prepass
from grainfold.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_retrieval_ties_limits_and_nothing(spark):
    corpus = spark.createDataFrame([(k, "same words here") for k in "cab"] + [("n", None), ("e", ""), ("o", "other text")], "key string, text string")
    assert [r.key for r in retrieval.retrieve(corpus, "words", 2).collect()] == ["a", "b"]
    assert retrieval.retrieve(corpus, "a ab", 5).collect() == [] and retrieval.retrieve(corpus, "unrelated", 5).collect() == []
    assert abs(retrieval.retrieve(corpus, "other text", 1).first().score - 1) < 1e-9


def test_retrieval_by_an_index_with_norms(spark):
    texts = [(f"k{i:02d}", " ".join(["alpha"] * (i % 4) + ["beta"] * (i % 3) + [f"own{i}", "Gamma"])) for i in range(60)] + [("n", None), ("e", "")]
    corpus = spark.createDataFrame(texts, "key string, text string")
    known = retrieval.index(corpus, with_norms=True)
    for question in ("alpha", "beta alpha alpha unseen", "own7 gamma", "unseen"):
        a, b = ({r.key: round(r.score, 9) for r in retrieval.scores(corpus, question, k).collect()} for k in (None, known))
        assert a == b and (a or question == "unseen")
    assert [r.key for r in retrieval.retrieve(corpus, "own7", 5, known).collect()] == ["k07"]


def test_snapshot_diff_reports_no_deletions(spark):
    s = lambda d: wiki.snapshot(spark.createDataFrame(list(d.items()), "concept_id string, body string"))
    assert rows(wiki.diff(s({"a": "1", "b": "2", "c": "3"}), s({"a": "1", "b": "x", "d": "4"}))) == [("b", "updated"), ("d", "created")]


def test_index_dirs_and_pages(spark):
    c = spark.createDataFrame([("top", None, None), ("a/b/c", "C", "about"), ("archive/x/y", None, None), ("a/z", "", "")], "concept_id string, title string, description string")
    assert rows(wiki.index_dirs(c)) == [("",), ("a",), ("a/b",)]
    pages = {r.dir: r.markdown for r in wiki.index_pages(c).collect()}
    assert pages["a/b"] == "# b Index\n\n* [C](c.md) - about\n"
    assert pages[""] == '---\nokf_version: "0.2"\n---\n\n# Wiki Index\n\n* [a/](a/)\n\n* [top](top.md)\n'
    many = spark.createDataFrame([(f"d/{x}", None, None) for x in ("b", "A", "ä", "a", "B", "a-b", "Z/x", "c/x")], "concept_id string, title string, description string")
    listed = {r.dir: r.markdown for r in wiki.index_pages(many).collect()}["d"]
    assert [x.partition("]")[0][3:] for x in listed.split("\n") if x.startswith("*")] == ["Z/", "c/", "a", "A", "ä", "a-b", "b", "B"]
    empty = spark.createDataFrame([], "concept_id string, title string, description string")
    assert {r.dir for r in wiki.index_pages(empty).collect()} == {""}


def test_orders_of_reports(spark):
    linked = spark.createDataFrame([("b", "x"), ("A", "y"), ("a", "z"), ("a", "B"), ("a", "a")], "from_concept_id string, to_concept_id string")
    assert [tuple(r) for r in wiki.ordered_links(linked).collect()] == [("a", "a"), ("a", "B"), ("a", "z"), ("A", "y"), ("b", "x")]
    assert [r.dir for r in wiki.ordered_dirs(spark.createDataFrame([("b",), ("A",), ("a/b",), ("a",)], "dir string")).collect()] == ["a/b", "a", "A", "b"]


def test_removal_plan(spark):
    ids = spark.createDataFrame([("a/x",), ("a/y",), ("b/z",), ("archive/q",)], "concept_id string")
    links = spark.createDataFrame([("b/z", "a/x"), ("b/z", "a/x"), ("a/y", "a/x"), ("b/z", "none")], "from_concept_id string, to_concept_id string")
    assert rows(wiki.removal_plan(ids, links, "wiki/a/")) == [("concept", "a/x", ""), ("concept", "a/y", ""), ("directory", "a", ""), ("link", "b/z", "a/x")]
    assert rows(wiki.removal_plan(ids, links, "a/x.md")) == [("concept", "a/x", ""), ("link", "a/y", "a/x"), ("link", "b/z", "a/x")]
    for bad in ("", "/a", "wiki", "a/../b", "archive", "a/index.md", "none"):
        assert rows(wiki.removal_plan(ids, links, bad)) == []


def test_markdown_links(spark):
    body = "[a](../b.md \"t\") ![i](x.png)\n```\n[no](/no.md)\n```\n[ref]: </c d.md>\n[u](https://x.invalid/a.md)"
    df = spark.createDataFrame([(1, body, "dir/me", "clash"), (2, None, "x", ""), (3, "", None, "")], "id int, body string, me string, dir string")
    assert rows(wiki.markdown_links(df, "id", "body", "me")) == [(1, "b"), (1, "c d")]
    assert rewrite.linked_concepts(body, "dir") == ["b", "c d"]


def test_greedy_batches(spark):
    images = spark.createDataFrame([("d", i, n) for i, n in enumerate([10, 10, 10, 1000, 60, 50])], "doc string, pos bigint, byte_length bigint")
    got = {r.pos: r.batch for r in intake.batches(images, 2, 100, 500).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 4: 2, 5: 3, 3: None}


def test_archive_targets_never_collide(spark):
    f = spark.createDataFrame([(1, "d/a.md"), (2, "d/a.md"), (3, "d/a.md"), (4, "b.txt"), (5, ".env"), (6, "c.pdf")], "id int, path string")
    existing = spark.createDataFrame([("archive/b.txt",), ("archive/c.pdf",), ("archive/c.S.pdf",), ("archive/c.S.1.pdf",)], "target string")
    got = dict(rows(intake.archive_targets(f, existing, "id", "path", "S")))
    assert got == {1: "archive/d/a.md.orig", 2: "archive/d/a.S.md.orig", 3: "archive/d/a.S.1.md.orig", 4: "archive/b.S.txt", 5: "archive/.env", 6: "archive/c.S.2.pdf"}


def test_outcomes(spark):
    text = ["- input/a/x.pdf `img-01`: **content** — a chart", "img-02 = decorative", "* img-03: unreadable - blur", "nothing", "- other.pdf img-01: decorative"]
    lines = spark.createDataFrame(list(enumerate(text)), "pos int, line string")
    assert [(r.doc, r.id, r.classification, r.note) for r in intake.parsed_outcomes(lines).orderBy("pos").collect()] == [("a/x.pdf", "img-01", "content", "a chart"), ("", "img-02", "decorative", ""), ("", "img-03", "unreadable", "blur"), ("other.pdf", "img-01", "decorative", "")]
    images = spark.createDataFrame([("x.pdf", "img-01", "staged"), ("x.pdf", "img-02", "failed"), ("x.pdf", "img-03", "staged"), ("y.pdf", "img-03", "staged"), ("y.pdf", "img-02", "analyzed")], "doc string, id string, status string")
    got = {(r.doc, r.id): r.status for r in intake.applied_outcomes(images, intake.parsed_outcomes(lines)).collect()}
    assert got == {("x.pdf", "img-01"): "analyzed", ("x.pdf", "img-02"): "decorative", ("x.pdf", "img-03"): "staged", ("y.pdf", "img-03"): "staged", ("y.pdf", "img-02"): "analyzed"}


def test_warnings_are_idempotent(spark):
    df = spark.createDataFrame([(0, " a  b "), (1, "c (×3)"), (2, "a b"), (3, "c"), (4, " "), (5, None)], "pos int, warning string")
    once = intake.aggregated_warnings(df)
    assert [r.warning for r in once.orderBy("first_pos").collect()] == ["a b (×2)", "c (×4)"]
    again = intake.aggregated_warnings(once.withColumnRenamed("first_pos", "pos"))
    assert rows(again) == rows(once)


def test_archive_links_longest_name_wins():
    m = {"a": "A", "a b.pdf": "X.pdf", "a b.pdf c": "no", "r+.md": "r.1.md", "same": "same"}
    text = "[x](/archive/a b.pdf) /archive/a, \"/archive/r+.md\" /archive/same /archive/a\n</archive/a b.pdf>"
    assert rewrite.redirect_archive(text, m) == "[x](/archive/X.pdf) /archive/a, \"/archive/r.1.md\" /archive/same /archive/A\n</archive/X.pdf>"
    assert rewrite.redirect_archive(rewrite.redirect_archive(text, m), m) == rewrite.redirect_archive(text, m)


def test_removed_links():
    m = {"a/x": "/trash/a/x y.md.orig", "b": "/trash/b.md.orig"}
    text = "---\nresource: ../b.md\nsources:\n  - resource: \"/a/x.md\"\n---\n[t](x.md \"T\") [u](</b.md>)\n```\n[t](x.md)\n```\n[r]: x.md\n[k](keep.md)"
    out = rewrite.redirect_removed(text, "a", m)
    assert out == "---\nresource: /trash/b.md.orig\nsources:\n  - resource: \"/trash/a/x y.md.orig\"\n---\n[t](</trash/a/x y.md.orig> \"T\") [u](/trash/b.md.orig)\n```\n[t](x.md)\n```\n[r]: </trash/a/x y.md.orig>\n[k](keep.md)"
    assert rewrite.redirect_removed(out, "a", m) == out and rewrite.redirect_removed("x\r\ny", "", m) == "x\r\ny"


def test_rewriting_frames(spark):
    docs = spark.createDataFrame([("a", "see /archive/o.txt)"), ("b", "nothing"), ("c", None), (None, "/archive/o.txt")], "concept_id string, content string")
    mapping = spark.createDataFrame([("o.txt", "n.txt"), ("o.txt", "z.txt"), ("x", "y")], "old string, new string")
    assert rows(rewrite.rewrite_archive_links(docs, mapping)) == [("a", "see /archive/n.txt)")]


def test_migration():
    old = "---\ntype: t\ntimestamp: 2024-01-01\nstatus: Current\nx: 1\n---\nText\n\n# Citations\n- [A (b)](<u v>)\n- <https://x.invalid/p/q.html>\n1. see https://y.invalid/z).\n* plain words\n[2] [A (b)](w)\n\n```\n# Citations\n```\n\n## Next\nmore"
    new = rewrite.migrate(old)
    head, body = rewrite.frontmatter.split_document(new)
    assert list(head) == ["type", "generated", "status", "x", "sources"] and head["generated"] == {"by": rewrite.LEGACY_ACTOR, "at": "2024-01-01"} and head["status"] == "stable"
    assert [(s["id"], s["resource"]) for s in head["sources"]] == [("a-b", "u v"), ("q-html", "https://x.invalid/p/q.html"), ("z", "https://y.invalid/z"), ("plain-words", "plain words"), ("a-b-2", "w")]
    assert body == "\nText\n\n## Next\nmore\n" and rewrite.migrate(new) is None and rewrite.migrate("no head") is None


def test_prepass(spark):
    def analyse(items):
        if any(i["id"] == "img-03" for i in items):
            raise RuntimeError("down")
        return "Sure:\n```json\n" + json.dumps({"findings": [{"id": "img-01", "classification": "content", "description": " d ", "legible_values": [1, " ", "x"]}, {"id": "img-09", "classification": "content"}, {"id": "img-02", "classification": "odd"}]}) + "\n```"

    df = spark.createDataFrame([("d", 1, "img-01", None, None, None, None), ("d", 1, "img-02", None, None, None, None), ("d", 2, "img-03", None, None, None, None)], "doc string, batch int, id string, locations array<string>, context string, media string, data binary")
    got = {r.id: r for r in prepass.run_prepass(df, analyse).collect()}
    assert (got["img-01"].status, got["img-01"].description, got["img-01"].legible_values) == ("analyzed", "d", ["1", "x"])
    assert (got["img-02"].status, got["img-03"].status, got["img-03"].reason) == ("failed", "failed", "down")
    counted = prepass.run_prepass(df, lambda items: prepass.Answer("{}", 10, len(items), 0.5))
    assert tuple(prepass.usage(counted).first()) == (2, 20, 3, 1.0)
    assert prepass.parse_answer('x [{"id": "a", "classification": "content"}] y', ["a"])["a"]["classification"] == "content" and prepass.parse_answer("none", ["a"]) == {} and prepass.parse_answer(None, ["a"]) == {}
    assert "img-01 at an unknown place" in prepass.instructions([{"id": "img-01"}])


def test_staged_images_and_findings(spark):
    from test_sources import chart

    one, two, tiny = chart(), chart(5), chart(0, 8)
    schema = "doc string, images array<struct<name:string,media:string,data:binary,location:string,context:string>>"
    shots = [("a", "image/png", one, "p 1", " "), ("b", "image/png", two, None, "x"), ("c", "image/png", one, "p 1", " near\nit "), ("d", "image/png", one, "p 2", "later"), ("e", "image/png", tiny, None, None), ("f", "image/png", None, None, None), ("g", "image/png", b"no", None, None)]
    df = spark.createDataFrame([("d", [(n, m, x and bytearray(x), p, c) for n, m, x, p, c in shots]), ("n", []), ("o", None)], schema)
    staged = prepass.staged_images(df).cache()
    got = {r.id: r for r in staged.collect()}
    assert {k: (r.status, len(r.occurrences)) for k, r in got.items()} == {"img-01": ("staged", 3), "img-02": ("staged", 1), "img-03": ("decorative", 1), "img-04": ("broken", 1)}
    asked = {r.id: r for r in prepass.request_batches(staged).collect()}
    assert set(asked) == {"img-01", "img-02"} and asked["img-01"].locations == ["p 1", "p 2"] and asked["img-01"].context == " near\nit " and asked["img-02"].locations == []
    found = prepass.run_prepass(prepass.request_batches(staged), lambda items: json.dumps([{"id": "img-01", "classification": "content", "description": "desc", "legible_values": ["v"], "uncertainties": ["u"]}]))
    shown = prepass.render_findings(prepass.with_findings(staged, found), 4).first().content
    assert shown.startswith("Image findings for input/d\n4 unique image(s), 6 occurrence(s). Status: staged 0, analyzed 1, decorative 1, unreadable 0, broken 1, failed 1.")
    assert "## img-01 — analyzed\nLocation: p 1\nAlso at: p 1 — near: near…\nAlso at: p 2 — near: late…\nDescription: desc\nLegible values:\n  - v\nUncertainties:\n  - u" in shown and "## img-02 — failed\nReason: no finding in the answer\nLocation: unknown — near: x" in shown


def test_commands(spark, tmp_path):
    root = str(tmp_path)
    put = lambda name, text: files.write_text(os.path.join(root, name), text)
    get = lambda name: open(os.path.join(root, name), encoding="utf-8").read()
    put("wiki/a/one.md", "---\ntype: T\ntitle: One\n---\n\nabout turbines [two](/b/two.md)\n")
    put("wiki/b/two.md", "---\ntype: T\ntitle: Two\ntimestamp: 2024-01-01\n---\n\nabout pumps, see /archive/new.md\n")
    put("input/new.md", "---\ntype: T\n---\n\nnew page\n")
    put("input/loose.md", "no head")
    put("input/page.html", "<p>hello</p>")
    put("input/index.md", "x")
    put("input/odd.xyz", "x")
    put("input/.DS_Store", "x")
    session = commands.begin(spark, root, "S")
    assert session.n_waiting == 2 and get("input/.extracted/page-extracted.txt") == "hello" and get("wiki/new.md").endswith("new page\n") and not os.path.exists(os.path.join(root, "input/new.md"))
    prompt = session.prompt()
    assert "- input/page.html (html) -> " in prompt and "Directories: a, b\nTypes in use: T (3)\nExisting ids: a/one, b/two, new" in prompt
    # The agent writes a page, archives its original and leaves the other file.
    put("wiki/c/page.md", "---\ntype: T\n---\n\n[from](/archive/page.html)\n")
    put("wiki/archive/page.html", "<p>hello</p>")
    os.unlink(os.path.join(root, "input/page.html"))
    put("wiki/b/two.md", get("wiki/b/two.md").replace("about", "all about"))
    r = commands.finish(spark, session, "2026-01-01", "The chart is illegible.\ndone")
    assert r.names("imported") == ["new.md"] and r.names("for_agent") == ["loose.md", "page.html"] and r.names("leftover") == ["loose.md"] and r.names("ignored") == ["index.md", "odd.xyz"]
    assert r.names("created") == ["c/page", "new"] and r.names("updated") == ["b/two"] and (r.concepts_before, r.concepts_after) == (2, 4)
    assert get("wiki/archive/page-extracted.txt") == "hello" and get("wiki/archive/new.md.orig").endswith("new page\n") and not os.path.exists(os.path.join(root, "input/.extracted"))
    assert "* [One](one.md)" in get("wiki/a/index.md") and "* **Creation**: Added [new](/new.md).\n* **Update**: Updated [b/two](/b/two.md).\n* **Warning**: Image analysis limitation reported by agent: The chart is illegible." in get("wiki/log.md")
    assert [x.concept_id for x in commands.query(spark, root, "turbines?").collect()] == ["a/one"]
    asked = commands.query_prompt(spark, root, "turbines?")
    assert "--- a/one ---" in asked and "# Wiki Index" in asked and asked.endswith("turbines?")
    plan = rows(commands.plan_removal(spark, root, "b"))
    assert plan == [("concept", "b/two", ""), ("directory", "b", ""), ("link", "a/one", "b/two")]
    m = commands.migrate(spark, root, "2026-01-02")
    assert m.names("updated") == ["b/two"] and commands.migrate(spark, root, "2026-01-03").counts == {}
    gone = commands.remove(spark, root, "b", "2026-01-04", "S")
    assert gone.names("removed") == ["b/two"] and gone.names("updated") == ["a/one"] and "(/trash/b/two.md.orig)" in get("wiki/a/one.md")
    assert "b" in gone.names("directory") and not os.path.exists(os.path.join(root, "wiki/b")) and get("wiki/log.md").startswith("# Wiki Update Log\n\n## 2026-01-04") and get("wiki/log.md").count("# Wiki Update Log") == 1
    assert commands.remove(spark, root, "none", "2026-01-05", "S").error


def test_update_with_images(spark, tmp_path):
    """A document with an image goes through the pre-pass, its findings are staged and archived, and what the agent says of failed images counts."""
    import base64

    from test_sources import chart

    root = str(tmp_path)
    uri = lambda seed: f'<img src="data:image/png;base64,{base64.b64encode(chart(seed)).decode()}">'
    files.write_text(os.path.join(root, "input/d/doc.html"), f"<h1>Head</h1><p>text {uri(0)}</p><p>{uri(7)}</p>")
    finding = json.dumps([{"id": "img-01", "classification": "content", "description": "a chart"}])

    def agent(prompt):
        assert "Images: 2 unique, 2 occurrence(s)" in prompt and "Image findings: " in prompt and "    - img-02: " in prompt and "    - img-01: " not in prompt
        files.write_text(os.path.join(root, "wiki/t/doc.md"), "---\ntype: T\n---\n\n[s](/archive/d/doc.html)\n")
        os.makedirs(os.path.join(root, "wiki/archive/d"))
        os.rename(os.path.join(root, "input/d/doc.html"), os.path.join(root, "wiki/archive/d/doc.html"))
        return "- d/doc.html img-02: decorative - a line"

    r = commands.update(spark, root, "2026-01-01", "S", agent, lambda items: prepass.Answer(finding, 5, 6, 0.25))
    read = lambda p: open(os.path.join(root, p), encoding="utf-8").read()
    assert r.names("images") == ["Pre-analysis: 1 call(s), 5 input / 6 output tokens, cost 0.2500.", "d/doc.html: 2 occurrence(s), 2 unique — staged 0, analyzed 1, decorative 1, unreadable 0, broken 0, failed 0; missing findings: none"]
    assert "Description: a chart" in read("wiki/archive/d/doc-image-findings.txt") and "* **Images**: d/doc.html: 2 occurrence(s)" in read("wiki/log.md") and not os.path.exists(os.path.join(root, "input/d"))


def test_commands_collect_no_contents(spark, tmp_path, monkeypatch):
    """Of 2,000 pages no content reaches the driver."""
    from pyspark.sql import DataFrame

    root, seen = str(tmp_path), []
    for i in range(2000):
        files.write_text(os.path.join(root, f"wiki/d{i % 7}/p{i}.md"), f"---\ntype: T\ntimestamp: 2024-01-01\n---\n\nsecret {i} [x](/d0/p0.md)\n")
    for name in ("collect", "toLocalIterator", "first"):
        plain = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, *a, plain=plain, **k: [seen.append(self.columns), plain(self, *a, **k)][1])
    assert commands.migrate(spark, root, "2026-01-01").counts == {"updated": 2000}
    assert commands.remove(spark, root, "d0/p0.md", "2026-01-02", "S").counts["updated"] == 1999
    assert commands.update(spark, root, "2026-01-03", "S").counts == {}
    assert not any({"content", "body", "hash", "markdown", "data"} & set(c) for c in seen) and "secret" in open(os.path.join(root, "wiki/d1/p1.md"), encoding="utf-8").read()


def test_faults_of_moves_are_reported(spark, tmp_path, monkeypatch):
    """What can't be moved stays and is told; directories with other files stay too."""
    root = str(tmp_path)
    put = lambda name, text: files.write_text(os.path.join(root, name), text)
    put("wiki/a/one.md", "---\ntype: T\n---\n\n[two](/b/two.md) [three](/b/c/three.md)\n")
    put("wiki/b/two.md", "---\ntype: T\n---\n\nx\n")
    put("wiki/b/c/three.md", "---\ntype: T\n---\n\nx\n")
    put("wiki/b/picture.png", "x")
    assert ("directory", "b", "") not in rows(commands.plan_removal(spark, root, "b")) and ("directory", "b/c", "") in rows(commands.plan_removal(spark, root, "b"))
    put("wiki/trash/b/c", "a file where a directory should be")
    r = commands.remove(spark, root, "b", "2026-01-01", "S")
    assert r.names("removed") == ["b/two"] and "Could not move" in r.names("warning")[0] and os.path.exists(os.path.join(root, "wiki/b/c/three.md"))
    assert "(/trash/b/two.md.orig) [three](/b/c/three.md)" in open(os.path.join(root, "wiki/a/one.md"), encoding="utf-8").read()
    put("wiki/archive/in", "a file")
    put("input/in/new.md", "---\ntype: T\n---\n\nnew\n")
    u = commands.update(spark, root, "2026-01-02", "S")
    assert u.names("imported") == [] and u.names("ignored") == ["in/new.md"] and u.names("warning")[0].startswith("Could not archive in/new.md: ") and os.path.exists(os.path.join(root, "input/in/new.md"))


def test_stamps():
    from datetime import UTC, datetime

    at = datetime(2026, 3, 4, 5, 6, 7, tzinfo=UTC)
    assert (commands.today(at), commands.archive_stamp(at)) == ("2026-03-04", "2026-03-04-0506") and len(commands.archive_stamp()) == 15


def test_commands_on_nothing(spark, tmp_path):
    r = commands.update(spark, str(tmp_path), "2026-01-01", "S")
    assert r.counts == {} and commands.query(spark, str(tmp_path), "anything").collect() == []


def test_line_records_of_one_long_document(spark):
    """A document that goes over several ranges is numbered in one row; bad and blank lines have no number."""
    lines = [("long", i, "{bad" if i % 10 == 0 else " " if i % 10 == 1 else json.dumps({"i": i})) for i in range(5000)] + [("short", 7, "[1]"), (None, 1, "1"), ("none", 1, None), ("long", 9000, "2")]
    got = intake.line_records(spark.createDataFrame(lines, "doc string, pos bigint, line string")).collect()
    numbers = {(r.doc, r.pos): (r.record_no, r.part_no) for r in got}
    good = [i for i in range(5000) if i % 10 > 1]
    assert len(got) == len(numbers) == 4503 and all(numbers["long", i] == (k, (k - 1) // 1000 + 1) for k, i in enumerate(good, 1))
    assert numbers["long", 0] == (None, None) and numbers["long", 9000] == (4001, 5) and numbers["short", 7] == numbers[None, 1] == (1, 1)
