import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import markdown, text
from lodestone.sources.vault import ignored, list_notes, scan_store, scan_vault, write_notes


def parse(spark, raw, path="dir/My note.md"):
    rows = spark.createDataFrame([(path, raw, 1.0)], "path string, raw string, mtime double")
    return markdown.parse_notes(rows).first()


def test_parse_note(spark):
    r = parse(spark, "---\na: 1\nb: x: y\na: 2\nnone\n---\n# The  Title \nSee [[X]] [[ Y#z|w]] #tag and #a/b-c no#t\n#1\n")
    assert (r.title, r.frontmatter, r.tags, r.wikilinks) == ("The  Title", {"a": "2", "b": "x: y"}, ["1", "a/b-c", "tag"], ["X", "Y"])
    assert r.body.startswith("# The")


def test_title_falls_back_to_the_stem(spark):
    assert parse(spark, "no heading\n## sub").title == "My note"
    assert parse(spark, "x", "a.b/.hidden").title == ".hidden"
    assert parse(spark, "#\n\nfoo").title == "foo"
    assert parse(spark, "text\n---\na: 1\n---\n").frontmatter == {}


def plain_sections(body):
    import re

    out, stack, held, path = [], [], [], ()
    for line in [*body.splitlines(), None]:
        m = re.match(r"^(#{1,6})\s+(.+)$", line) if line is not None else None
        if line is None or m:
            if "\n".join(held).strip():
                out.append((list(path), "\n".join(held).strip()))
            held = []
        if m:
            n = len(m[1])
            stack = (stack + [""] * 6)[: n - 1] + [m[2].strip()]
            path = [s for s in stack if s]
        if line is not None:
            held.append(line)
    return out


def test_sections_equal_a_plain_scan(spark):
    rng = random.Random(1)
    bodies = ["", "\n \n", "# T\n## A\nx\n## B\n#### C\n### D\n", "#no\n####### seven\n#\tTab\r\nq"]
    bodies += ["\n".join(rng.choice(["# a", "## b ", "### c", "###### f", "text", "", " # no", "#### d d"]) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    for r in rows.select("i", markdown.sections(F.col("body")).alias("s")).collect():
        assert [(list(x.heading_path), x.text) for x in r.s] == plain_sections(bodies[r.i])


def test_chunks_keep_words_and_count_from_zero(spark):
    body = "intro\n# T\n" + " ".join(f"w{i}" for i in range(50)) + "\n## U\nshort  text"
    notes = spark.createDataFrame([("a.md", body), ("empty.md", " \n ")], "path string, body string")
    got = sorted(markdown.chunk_notes(notes, 20).collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in got] == list(range(5)) and all(r.token_count <= 20 for r in got)
    assert " ".join(r.text for r in got).split() == body.split()
    assert got[-1].text == "## U\nshort  text" and got[-1].heading_path == ["T", "U"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    t = lambda s: F.lit(s)
    assert one(spark, text.tokens(t("Città foo_bar Über2 ß"))) == ["citta", "foo", "bar", "uber2", "ß"]
    assert one(spark, text.phrases(t("?? foo_bar -- x"))) == [["foo", "bar"], ["x"]]
    assert one(spark, text.word_count(t(" \t\n"))) == 0 and one(spark, text.word_count(t(" a b\x0bc "))) == 3
    assert one(spark, text.normalize_ws(t("  A b\r\nC "))) == "a b c"
    assert one(spark, text.percent_encoded(t("Go (game)/a*b~c+é"))) == "Go%20%28game%29/a%2Ab~c%2B%C3%A9"


@pytest.mark.parametrize("title,lang,want", [("Città di Roma", "it", "citta-di-roma-it"), ("Straße Ł", "en", "stra-e"), ("日本", "en", ""), ("日本", "it", ""), ("A  B--c!", "en", "a-b-c")])
def test_slugs(spark, title, lang, want):
    assert text.slug_of(title, lang) == want
    assert one(spark, text.slug(F.lit(title), F.lit(lang))) == want


def test_scan(spark, tmp_path):
    for name, data in (("b.md", b"x\r\ny"), ("a/c.md", b""), ("_u.md", b"u"), (".obsidian/z.md", b"z"), ("n.txt", b"t"), ("trash.md", b"q")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r.raw for r in scan_vault(spark, str(tmp_path), [".obsidian/", "trash.md"]).collect()}
    assert got == {"b.md": "x\ny", "a/c.md": "", "_u.md": "u"}
    assert {r.path: r.raw for r in scan_store(spark, str(tmp_path), ["trash.md"]).collect()} == {"b.md": "x\ny"}
    assert ignored("a/b", ["a/"]) and not ignored("b/a", ["a/"])
    write_notes(spark.createDataFrame([("new/n.md", "hi\n")], "path string, text string"), str(tmp_path))
    assert (tmp_path / "new/n.md").read_text() == "hi\n" and "new/n.md" in list_notes(str(tmp_path))
