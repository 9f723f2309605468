"""Markdown notes as columns: front matter, title, tags, links, and heading-aware chunks. Nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip, words

FRONT = r"(?s)\A---\n(.*?)\n---\n"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
OTHER_ENDS = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
HEADING = r"(?Ud)\A(#{1,6})\s+(.+)\z"


def lines(text: Column) -> Column:
    """As str.splitlines: every kind of line end counts, and a final one ends the last line."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def front_matter(raw: Column) -> Column:
    """map<string,string> of the block between --- lines at the very start; a later key wins, lines without : are passed over."""
    pairs = F.transform(
        F.filter(lines(F.regexp_extract(raw, FRONT, 1)), lambda x: x.contains(":")),
        lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).alias("value")),
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def body_of(raw: Column) -> Column:
    return F.regexp_replace(raw, FRONT, "")


def title_of(body: Column, path: Column) -> Column:
    """The first level-1 heading, else the path's stem."""
    h1 = r"(?Udm)^#\s+(.+)$"
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    stem = F.when(name.rlike(r"\A.+\.[^.]+\z"), F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name)
    return F.when(body.rlike(h1), strip(F.regexp_extract(body, h1, 1))).otherwise(stem)


def tags_of(body: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?:^|(?U:\s))#([A-Za-z0-9_\-/]+)"), F.lit(1))))


def links_of(body: Column) -> Column:
    found = F.regexp_extract_all(body, F.lit(r"\[\[([^\]|#]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, strip)))


def parse_notes(files: DataFrame) -> DataFrame:
    """path, title, frontmatter, tags, wikilinks, content_hash, mtime and body of files(path, raw, mtime)."""
    rows = files.withColumn("body", body_of(F.col("raw")))
    return rows.select(
        "path",
        title_of(F.col("body"), F.col("path")).alias("title"),
        front_matter(F.col("raw")).alias("frontmatter"),
        tags_of(F.col("body")).alias("tags"),
        links_of(F.col("body")).alias("wikilinks"),
        F.sha2(F.col("raw"), 256).alias("content_hash"),
        "mtime",
        "body",
    )


def sections(body: Column) -> Column:
    """array<struct<heading_path, text>>: a heading line opens a section; its path holds the headings above it by level.

    The lines are joined again and cut before each heading, so that one fold over the parts, not the lines, keeps the titles by level and the sections."""
    state = "struct<stack:array<string>,done:array<struct<heading_path:array<string>,text:string>>>"
    zero = F.from_json(F.lit('{"stack":["","","","","",""],"done":[]}'), state)

    def step(acc: Column, part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        level, title, text = F.char_length(F.regexp_extract(head, HEADING, 1)), strip(F.regexp_extract(head, HEADING, 2)), strip(part)
        stack = F.transform(acc["stack"], lambda t, i: F.when(i + 1 < level, t).when(i + 1 == level, title).otherwise(F.when(level == 0, t).otherwise("")))
        path = F.filter(stack, lambda t: t != "")
        done = F.when(text == "", acc["done"]).otherwise(F.array_append(acc["done"], F.struct(path.alias("heading_path"), text.alias("text"))))
        return F.struct(stack.alias("stack"), done.alias("done"))

    parts = F.split(F.array_join(lines(body), "\n"), r"(?Ud)\n(?=#{1,6}(?!#)[^\S\n][^\n])", -1)
    several = F.aggregate(parts, zero, lambda acc, x: step(acc, x).cast(state), lambda acc: acc["done"])
    whole = strip(F.when(body.rlike(OTHER_ENDS), F.regexp_replace(body, LINE_ENDS, "\n")).otherwise(body))
    one = F.filter(F.array(F.struct(F.array().cast("array<string>").alias("heading_path"), whole.alias("text"))), lambda s: s["text"] != "")
    return F.when(F.contains(body, F.lit("#")), several).otherwise(one)  # most texts have no heading at all


def pieces(text: Column, most: int) -> Column:
    """array<struct<text, token_count>>: text itself if it has at most `most` words, else windows of so many words, joined by spaces. The words are split once."""
    one = lambda t, n: F.struct(t.alias("text"), n.alias("token_count"))

    def cut(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / most).cast("int")), lambda k: F.slice(w, k * most + 1, most))
        return F.when(F.size(w) <= most, F.array(one(text, F.size(w)))).otherwise(F.transform(windows, lambda x: one(F.array_join(x, " "), F.size(x))))

    return F.transform(F.array(words(text)), cut)[0]


def chunk_notes(notes: DataFrame, max_tokens: int = 512) -> DataFrame:
    """note_path, ordinal (from 0), heading_path, text and token_count of each chunk of notes(path, body)."""
    part = lambda s: F.transform(pieces(s["text"], max_tokens), lambda p: F.struct(s["heading_path"].alias("heading_path"), p["text"].alias("text"), p["token_count"].alias("token_count")))
    rows = notes.select(F.col("path").alias("note_path"), F.posexplode(F.flatten(F.transform(sections(F.col("body")), part))).alias("ordinal", "c"))
    return rows.select("note_path", "ordinal", *(F.col(f"c.{x}").alias(x) for x in ("heading_path", "text", "token_count")))
