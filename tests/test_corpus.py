import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import slug, slug_of
from lodestone.operators import corpus, wikitext
from lodestone.operators.wikitext import resolve_templates

#: Input and output of templates, by rule; what is tallied only where something is dropped.
TEMPLATES = {
    "a measure without what it is converted to": [("a {{cvt|25|kg|lb|0|abbr=off}} load", "a 25 kg load"), ("{{Convert|7}}", "7"), ("{{convert|-3.5|C|F}}", "-3.5 C"), ("{{convert| 8 | km }}", "8 km")],
    "ranges": [("{{convert|2|to|3|mi|km}}", "2 to 3 mi"), ("{{convert|2|by|3|m}}", "2 by 3 m"), ("{{convert|10|–|12|L}}", "10–12 L"), ("{{convert|5|+/-|1|s}}", "5 ± 1 s"), ("{{cvt|3|x(-)|4|m|ft}}", "3 x 4 m")],
    "mixed numbers": [("{{convert|2+3/4|mi}}", "2 3/4 mi"), ("{{convert|1+1/2|and|2+1/2|in}}", "1 1/2 and 2 1/2 in"), ("{{convert|1/2|mi}}", "1/2 mi")],
    "a precision or unit is no range": [("{{convert|6|oz|2}}", "6 oz"), ("{{convert|6|m|ft|1}}", "6 m"), ("{{convert|6|usgal|L|1}}", "6 usgal")],
    "fractions": [("{{frac|5|8}}", "5/8"), ("{{frac|1|5|8}}", "1 5/8"), ("{{frac|8}}", "1/8"), ("7{{frac|8}}", "7 1/8"), ("x{{frac}}y", "xy"), ("{{9/16}}", "9/16"), ("{{convert|2|{{frac|3|4}} mi}}", "2 3/4 mi")],
    "words of other languages": [("{{lang|fr|chat}}", "chat"), ("{{wikt-lang|de|[[u|v]]}}", "[[u|v]]"), ("{{langx|ar|lit=no|{{script/Arab|q}}}}", "q"), ("{{script/Grek|w}}", "w")],
    "times": [("{{circa|900}}", "c. 900"), ("{{circa}}", "c."), ("{{floruit}}", "fl."), ("{{siglo|IV}}", "IV"), ("{{siglo|IV||S}}", "Siglo IV"), ("{{siglo|IV||s}}", "siglo IV"), ("{{siglo|IV||x}}", "IV")],
    "notes": [("{{music|Sharp}}", "♯"), ("{{music|bb}}", "𝄫"), ("{{music|time|6|8}}", "6/8")],
    "text": [("{{nobr|x y}}", "x y"), ("{{nowrap|1=p = q}}", "p = q"), ("5{{nbsp}}s", "5 s"), ("{{ill|Ort|de|Ort}}", "[[Ort]]"), ("{{formatnum: 4500 }}", "4500")],
    "quotations": [("{{blockquote|So.|Ann|Book}}", '"So." — Ann, Book'), ("{{blockquote|author=Ann|So.}}", '"So." — Ann'), ("{{blockquote|text=So.|Ann}}", '"So." — Ann'), ("{{blockquote|Now y = z holds|Ann}}", '"Now y = z holds" — Ann')],
    "what is open stays": [("{{infobox|a=1", "{{infobox|a=1"), ("p }} q {{x", "p }} q {{x")],
}
DROPPED = [
    ("{{music|longa}}", "", {"UNKNOWN-MUSIC-ARG:longa": 1}), ("{{convert|1|qq|2|m}}", "1 qq 2 m", {"UNKNOWN-CONVERT-JOINER:qq": 1}), ("{{convert|1|~|2|m}}", "1 ~ 2 m", {"UNKNOWN-CONVERT-JOINER:~": 1}),
    ("{{Refn|a{{b}}}}c", "c", {"refn": 1}), ("{{blockquote|So.{{refn|x}}}}", '"So."', {"refn": 1}), ("{{nowrap|{{q}}}}", "", {"q": 1}), ("{{lang|fr|}}", "", {"EMPTY-EXPANSION:lang": 1}),
]


@pytest.mark.parametrize("rule", TEMPLATES)
def test_templates(rule):
    for given, want in TEMPLATES[rule]:
        assert resolve_templates(given) == (want, {}), given


@pytest.mark.parametrize("given,want,tally", DROPPED)
def test_dropped_templates(given, want, tally):
    got, told = resolve_templates(given)
    assert got == want and {k: v for k, v in told.items() if k in tally} == tally


def test_footnotes_and_containers():
    for given, want in [
        ("p<ref name=q>see <i>r</i></ref>s", "ps"), ("p<REF name=q />s", "ps"), ("p<references />s<references><ref>x</ref></references>t", "pst"), ("p<ref>one<ref>two</ref>q", "p<ref>oneq"),
        ("p<ref>one", "p<ref>one"), ("p</ref>q", "p</ref>q"), ("p<ref>a<ref name=b/>c</ref>d", "pd"), ("<reflist>", "<reflist>"),
    ]:
        assert wikitext.strip_refs(given) == want, given
    for given, want in [("p[[Q#cite note-7|[7]]]r", "pr"), ("p[[Q#cite_ref-7|7]]r", "pr"), ("p[[Q#Cite note 1]]r", "pr"), ("p[[Q#city note|7]]r", "p[[Q#city note|7]]r")]:
        assert wikitext.strip_backlinks(given) == want, given
    assert wikitext.strip_containers("p<timeline>x\ny</timeline>q<chem/>r<score>open") == "pqr<score>open"


STAGES = [
    (wikitext.strip_comments, "p<!-- q\n\n-->r<!-- s", "pr<!-- s"),
    (wikitext.convert_lists, "* p\n*** q\n## r\n; s\n:: t\n:** u\n# *v\nw * x\n" + "*" * 15 + "y", "- p\n    - q\n  1. r\ns\nt\n  - u\n1. *v\nw * x\n" + "  " * 14 + "- y"),
    (wikitext.convert_headings, "==Up==\n==== Low ====  \n=== Odd ==\n= no =", "## Up\n#### Low\n## = Odd\n= no ="),
    (wikitext.convert_emphasis, "'''p''' q ''r'' '''''s''''' ''t\nu''", "**p** q *r* ***s*** ''t\nu''"),
    (wikitext.strip_external_links, "[https://p.org/q?r=1 the page] [//p.org] [ftp:x y z] [note] [a: b] [[Category:Q]] [[File:r s]]", "the page  y z [note] [a: b] [[Category:Q]] [[File:r s]]"),
    (wikitext.tidy_punctuation, "p ( ; ) q (r, ) (, s) t , u", "p  q (r) (s) t, u"),
    (wikitext.drop_sections, "p\n## Notes\nq\n### Deeper\nr\n## Kept\ns\n### *Further reading*\nt\n#### u\nv\n### Also kept\nw\n# See also\nx", "p\n## Kept\ns\n### Also kept\nw"),
    (wikitext.drop_sections, "## Gallery\np", ""), (wikitext.drop_sections, "no heading\n#tag\n", "no heading\n#tag\n"),
    (wikitext.normalize_blank_lines, "\n p \t\n\n\n\nq\n\n", "p\n\nq"),
]


def test_stages(spark):
    for stage, given, want in STAGES:
        assert spark.range(1).select(stage(F.lit(given)).alias("x")).first().x == want, given


def test_links():
    to = {"oak tree": "oak-tree"}
    for given, want in (
        ("[[Oak tree]]", "[[oak-tree|Oak tree]]"), ("[[oak  TREE]]s.", "[[oak-tree|oak  TREEs]]."), ("[[Oak_tree#Bark|its bark]]", "[[oak-tree|its bark]]"), ("[[Oak tree|oak-tree]]", "[[oak-tree]]"), ("[[Elm]]", "Elm"),
        ("[[Elm|the elm]]s", "the elms"), ("[[Elm (plant)| ]]", "Elm (plant)"), ("[[categoria:Alberi]]", ""), ("[[:Category:Trees]]", "Category:Trees"), ("[[#Bark]]", "#Bark"), ("[[Elm", "[[Elm"), ("[[[Elm]]]", "[Elm]"), ("[[a\nb]]", "[[a\nb]]"), ("[[|x]]", "[[|x]]"),
    ):
        assert wikitext.convert_links(given, to) == want, given


def test_scanners_leave_what_never_closes():
    assert wikitext.parse_page("p{|q{|r|}s|}t [[Imagen:u|[[v]] w]]x [[Image:open")[0] == "pt x [[Image:open"
    assert wikitext.parse_page("&sect;&nbsp;4 &amp;lt; &lt;p&gt;<em class=x>q</em> 3 < 4")[0] == "§ 4 &lt; <p>q 3 < 4"


def page(text, revid=7, **more):
    return json.dumps({"query": {"pages": [{"title": "T", "revisions": [{"revid": revid, "slots": {"main": {"content": text, "contentmodel": "wikitext"}}}]} | more]}})


def test_fetch_errors():
    assert corpus.fetch_article(lambda u: (200, page("x")), "en", "T", 7)["wikitext"] == "x"
    bad = [((503, ""), True), ((429, ""), True), ((404, ""), False), ((200, "no"), False), ((200, '{"error": {"info": "slow"}}'), True), ((200, '{"query": {"badrevids": {"7": {}}}}'), False), ((200, page("x", missing=True)), False), ((200, page("x", 8)), False), ((200, '{"query": {"pages": []}}'), False)]
    for answer, retry in bad:
        with pytest.raises(corpus.FetchError) as e:
            corpus.fetch_article(lambda u, a=answer: a, "en", "T", 7)
        assert e.value.retryable is retry
    assert [corpus.wait_after(n) for n in range(4)] == [0.2, 5, 15, 45]


def test_build(spark):
    rows = corpus.load_manifest('{"clusters": [{"name": "music", "articles": [{"title": "T", "lang": "en", "revid": 7}, {"title": "Due", "lang": "it", "revid": 7}]}]}')
    assert corpus.load_manifest(corpus.save_manifest(rows)) == rows
    notes, dropped, got = corpus.build_corpus(spark, rows, lambda u: (200, page("'''x''' [[Due]] {{cite a}}")), lambda s: None)
    by = {r.path: r.text for r in notes.collect()}
    assert set(by) == {"music/t.md", "music/due-it.md"} and dropped == {"cite a": 2} and not got.failures
    assert by["music/due-it.md"] == "---\ntitle: Due\nlang: it\ncluster: music\nrevid: 7\nsource: https://it.wikipedia.org/w/index.php?title=Due&oldid=7\nlicense: CC BY-SA 4.0\n---\n\n# Due\n\n**x** [[due-it|Due]]\n"
    stop = corpus.fetch_all(rows * 3, lambda u: (503, ""), lambda s: None)
    assert stop.aborted and len(stop.failures) == 3
    assert corpus.write_notice("head\n" + corpus.SENTINEL + "\nold", corpus.notice_rows(rows)).count("|") == 6
    with pytest.raises(ValueError):
        corpus.write_notice("none", [])
    assert corpus.reconcile(rows, [], lambda p: p == "music/t.md") == rows[:1]
    art = spark.createDataFrame([(r["cluster"], r["title"], r["lang"], r["revid"]) for r in rows], corpus.ARTICLES)
    assert corpus.fetch_articles(art, lambda u: (404, "")).where("error is not null").count() == 2


def test_build_from_end_to_end(spark, tmp_path):
    manifest, notice, root = tmp_path / "m.json", tmp_path / "NOTICE", tmp_path / "notes"
    manifest.write_text('{"clusters": [{"name": "trees", "articles": [{"title": "Tiếng", "lang": "en"}, {"title": "ﬁr ½", "lang": "de", "revid": 7}, {"title": "Gone", "lang": "en"}]}]}')
    notice.write_text("head\n" + corpus.SENTINEL + "\nold | x\n")
    get = lambda url: (404, "") if "Gone" in url else (200, page("p {{odd}}"))
    told = corpus.build(spark, str(manifest), str(notice), str(root), get, lambda s: None)
    assert told.splitlines()[0] == "2 notes written, 1 failures" and "odd" in told and "Gone" in told
    paths = sorted(str(p.relative_to(root)) for p in root.rglob("*.md"))
    assert paths == ["trees/fir-1-2-de.md", "trees/tieng.md"]
    rows = corpus.load_manifest(manifest.read_text())
    assert sorted(corpus.note_path(r["cluster"], r["title"], r["lang"]) for r in rows) == paths and {r["revid"] for r in rows} == {7}
    have = spark.createDataFrame([(p,) for p in [*paths, "trees/other.md"]], "path string")
    assert [r.path for r in corpus.unattributed(have, notice.read_text()).collect()] == ["trees/other.md"]


def test_slugs_of_rows_and_strings_agree(spark):
    titles = ["Tiếng Việt", "ﬁn ② ½", "İstanbul", "Ⅷ x²", "Ｆｕｌｌ", "straße", "𝐁old", "a\u0301b", "--", "Ω 5 µm", "№ 3"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", slug(F.col("t"), F.lit("it")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == {t: slug_of(t, "it") for t in titles}


def test_manifest_validation(spark):
    bad = '{"clusters": [{"name": "a/b", "articles": [{"title": "??", "lang": "EN", "revid": 0}, {"title": "Á", "lang": "en"}, {"title": "a", "lang": "en", "revid": true}]}]}'
    with pytest.raises(ValueError) as e:
        corpus.load_manifest(bad)
    assert all(x in str(e.value) for x in ("cluster name", "language", "slug", "revision 0", "revision True", "share the path"))
    with pytest.raises(ValueError):
        corpus.link_targets([{"title": "A b", "lang": "en"}, {"title": "a  B", "lang": "en"}])
