"""Building a corpus of pinned articles: manifest, validation, fetching, notes, attribution."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import percent_encoded, permalink_of, slug, slug_of
from lodestone.operators.wikitext import squeeze
from lodestone.sources.shared import checkpoint

RETRYABLE = (429, 503)
SENTINEL = "--- articles ---"
PAUSE, BACKOFF, MOST_FAILURES = 0.2, 5.0, 3
ARTICLES = "cluster string, title string, lang string, revid long"


def note_path(cluster: str, title: str, lang: str) -> str:
    return f"{cluster}/{slug_of(title, lang)}.md"


def load_manifest(text: str) -> list[dict]:
    """cluster, title, lang and revid of each article of a JSON manifest. A wrong structure raises at once; wrong values are told together."""
    data = json.loads(text)
    if not isinstance(data, dict) or not isinstance(data.get("clusters"), list):
        raise ValueError("the manifest needs a list 'clusters'")
    rows, errors = [], []
    for c in data["clusters"]:
        if not isinstance(c, dict) or not isinstance(c.get("articles"), list) or not isinstance(c.get("name"), str):
            raise ValueError("each cluster needs a name and a list 'articles'")
        for a in c["articles"]:
            if not isinstance(a, dict) or not isinstance(a.get("title"), str) or not isinstance(a.get("lang"), str):
                raise ValueError(f"cluster {c['name']}: each article needs a title and a lang")
            rows.append({"cluster": c["name"], "title": a["title"], "lang": a["lang"], "revid": a.get("revid")})
    for r in rows:
        errors += article_errors(r)
    seen: dict[str, dict] = {}
    for r in rows:
        key = note_path(r["cluster"], r["title"], r["lang"]).lower()
        if key in seen:
            errors.append(f"{r['title']!r} and {seen[key]['title']!r} share the path {key}")
        seen.setdefault(key, r)
    if errors:
        raise ValueError("; ".join(errors))
    return rows


def article_errors(r: dict) -> list[str]:
    out, name = [], r["cluster"]
    if not name.strip() or any(x in name for x in ("/", "\\", "..")):
        out.append(f"bad cluster name {name!r}")
    if not re.fullmatch("[a-z]{2,3}", r["lang"]):
        out.append(f"{r['title']!r}: bad language {r['lang']!r}")
    if not slug_of(r["title"]):
        out.append(f"{r['title']!r}: no letters or digits for a slug")
    if r["revid"] is not None and (isinstance(r["revid"], bool) or not isinstance(r["revid"], int) or r["revid"] < 1):
        out.append(f"{r['title']!r}: bad revision {r['revid']!r}")
    return out


def save_manifest(rows: list[dict]) -> str:
    clusters: dict[str, list] = {}
    for r in rows:
        a = {"title": r["title"], "lang": r["lang"]} | ({"revid": r["revid"]} if r["revid"] is not None else {})
        clusters.setdefault(r["cluster"], []).append(a)
    return json.dumps({"clusters": [{"name": k, "articles": v} for k, v in clusters.items()]}, indent=2, ensure_ascii=False) + "\n"


def manifest_errors(articles: DataFrame) -> DataFrame:
    """cluster, title and error of bad rows of articles(cluster, title, lang, revid): the checks of load_manifest as one scan."""
    checks = [
        (F.col("cluster").rlike(r"[/\\]|\.\.") | (F.btrim("cluster") == ""), "bad cluster name"),
        (~F.col("lang").rlike("^[a-z]{2,3}$"), "bad language"),
        (slug(F.col("title"), F.lit("en")) == "", "empty slug"),
        (F.col("revid") < 1, "bad revision"),
    ]
    found = F.filter(F.array(*(F.when(c, F.lit(m)) for c, m in checks)), lambda x: x.isNotNull())
    return articles.select("cluster", "title", F.explode(found).alias("error"))


def slug_collisions(articles: DataFrame) -> DataFrame:
    """path and n of note paths that several articles share, case aside."""
    path = F.lower(F.concat("cluster", F.lit("/"), slug(F.col("title"), F.col("lang")), F.lit(".md")))
    return articles.groupBy(path.alias("path")).agg(F.count("*").alias("n")).where("n > 1")


def link_targets(rows: list[dict]) -> dict[str, dict[str, str]]:
    """lang -> squeezed title -> slug; two articles of one title and language raise."""
    out: dict[str, dict[str, str]] = {}
    for r in rows:
        own = out.setdefault(r["lang"], {})
        if squeeze(r["title"]) in own:
            raise ValueError(f"two articles {r['title']!r} in {r['lang']}")
        own[squeeze(r["title"])] = slug_of(r["title"], r["lang"])
    return out


class FetchError(Exception):
    def __init__(self, message: str, retryable: bool = False) -> None:
        super().__init__(message)
        self.retryable = retryable


Get = Callable[[str], tuple[int, str]]


def http_get(url: str) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "lodestone corpus builder"}), timeout=30) as r:  # noqa: S310
            return r.status, r.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        return e.code, ""


def fetch_article(get: Get, lang: str, title: str, revid: int | None = None) -> dict:
    """title, revid and wikitext of a page, by title or exact revision. FetchError says whether it's worth trying again."""
    what = {"revids": str(revid)} if revid is not None else {"titles": title, "redirects": "1"}
    query = {"action": "query", "prop": "revisions", "rvprop": "ids|content", "rvslots": "main", "format": "json", "formatversion": "2"} | what
    name = f"{lang}:{title}"
    try:
        status, text = get(f"https://{lang}.wikipedia.org/w/api.php?{urllib.parse.urlencode(query)}")
    except OSError as e:
        raise FetchError(f"{name}: {e}", True) from e
    if status != 200:
        raise FetchError(f"{name}: HTTP {status}", status in RETRYABLE)
    try:
        data = json.loads(text)
    except ValueError as e:
        raise FetchError(f"{name}: the answer isn't JSON") from e
    if not isinstance(data, dict):
        raise FetchError(f"{name}: unexpected answer")
    if "error" in data:
        raise FetchError(f"{name}: {data['error'].get('info', 'API error') if isinstance(data['error'], dict) else data['error']}", True)
    found = data.get("query", {})
    if found.get("badrevids"):
        raise FetchError(f"{name}: no revision {revid}")
    pages = found.get("pages") or []
    if not pages:
        raise FetchError(f"{name}: no page in the answer")
    page = pages[0]
    for flag in ("missing", "invalid"):
        if page.get(flag):
            raise FetchError(f"{name}: the page is {flag}")
    revisions = page.get("revisions") or []
    if not revisions:
        raise FetchError(f"{name}: no revision in the answer")
    main = revisions[0].get("slots", {}).get("main", {})
    if main.get("contentmodel") != "wikitext":
        raise FetchError(f"{name}: content model {main.get('contentmodel')!r}")
    if not isinstance(main.get("content"), str):
        raise FetchError(f"{name}: the revision has no text")
    if revid is not None and revisions[0].get("revid") != revid:
        raise FetchError(f"{name}: got revision {revisions[0].get('revid')}, not {revid}")
    return {"title": page.get("title", title), "revid": revisions[0]["revid"], "wikitext": main["content"]}


def wait_after(failures: int) -> float:
    """Seconds before the next request: a short pause, or 5, 15, 45 after 1, 2, 3 failures in a row."""
    return PAUSE if failures == 0 else BACKOFF * 3 ** (failures - 1)


@dataclass
class Build:
    pages: list[dict] = field(default_factory=list)
    failures: list[str] = field(default_factory=list)
    aborted: bool = False


def fetch_all(rows: list[dict], get: Get = http_get, sleep: Callable[[float], None] = time.sleep) -> Build:
    """Fetches in order, politely; gives up after three retryable failures in a row."""
    out, row = Build(), 0
    for r in rows:
        try:
            out.pages.append(r | fetch_article(get, r["lang"], r["title"], r["revid"]) | {"title": r["title"]})
            row = 0
        except FetchError as e:
            out.failures.append(str(e))
            row = row + 1 if e.retryable else 0
            if row >= MOST_FAILURES:
                out.aborted = True
                break
        sleep(wait_after(row))
    return out


def fetch_articles(articles: DataFrame, get: Get) -> DataFrame:
    """The same for a DataFrame of articles, each task fetching its own: cluster, title, lang, revid, wikitext and error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for r in p.itertuples(index=False):
                revid = None if pd.isna(r.revid) else int(r.revid)
                try:
                    got = fetch_article(get, r.lang, r.title, revid)
                    rows.append((r.cluster, r.title, r.lang, got["revid"], got["wikitext"], None))
                except FetchError as e:
                    rows.append((r.cluster, r.title, r.lang, revid, None, str(e)))
            yield pd.DataFrame(rows, columns=["cluster", "title", "lang", "revid", "wikitext", "error"])

    return articles.mapInPandas(run, ARTICLES + ", wikitext string, error string")


def render_notes(pages: DataFrame) -> DataFrame:
    """path and text of a note for each of pages(cluster, title, lang, revid, markdown): front matter, then the text."""
    link = F.concat(F.lit("https://"), "lang", F.lit(".wikipedia.org/w/index.php?title="), percent_encoded(F.replace("title", F.lit(" "), F.lit("_"))), F.lit("&oldid="), F.col("revid").cast("string"))
    head = [F.concat(F.lit(f"{k}: "), c) for k, c in (("title", F.col("title")), ("lang", F.col("lang")), ("cluster", F.col("cluster")), ("revid", F.col("revid").cast("string")), ("source", link), ("license", F.lit("CC BY-SA 4.0")))]
    text = F.concat(F.lit("---\n"), F.concat_ws("\n", *head), F.lit("\n---\n\n"), F.regexp_replace("markdown", r"(?U)\A\s+", ""))
    path = F.concat("cluster", F.lit("/"), slug(F.col("title"), F.col("lang")), F.lit(".md"))
    return pages.select(path.alias("path"), text.alias("text"))


def notice_rows(rows: list[dict]) -> list[str]:
    return [f"{note_path(r['cluster'], r['title'], r['lang'])} | {r['title']} | {r['lang']} | {permalink_of(r['lang'], r['title'], r['revid'])}" for r in rows]


def write_notice(text: str, rows: list[str], sentinel: str = SENTINEL) -> str:
    """text with all behind its one sentinel line replaced by the rows, sorted by code point."""
    if text.count(sentinel) != 1:
        raise ValueError(f"the notice must hold {sentinel!r} once, not {text.count(sentinel)} times")
    return "\n".join([text.partition(sentinel)[0] + sentinel, *sorted(rows)]) + "\n"


def reconcile(before: list[dict], built: list[dict], exists: Callable[[str], bool]) -> list[dict]:
    """The manifest after a run: what was built anew, else the entry from before if its note is still there."""
    new = {(r["lang"], r["title"]): r for r in built}
    rows = [new.get((r["lang"], r["title"]), r) for r in before]
    return [r for r in rows if (r["lang"], r["title"]) in new or exists(note_path(r["cluster"], r["title"], r["lang"]))]


def build_corpus(spark: SparkSession, rows: list[dict], get: Get = http_get, sleep: Callable[[float], None] = time.sleep) -> tuple[DataFrame, Counter, Build]:
    """Notes (path, text), what was dropped by name, and the account of fetching."""
    from lodestone.operators.wikitext import dropped_tally, to_markdown

    got = fetch_all(rows, get, sleep)
    pages = spark.createDataFrame([(p["cluster"], p["title"], p["lang"], p["revid"], p["wikitext"]) for p in got.pages], ARTICLES + ", wikitext string")
    known = [(lang, title, s) for lang, own in link_targets(rows).items() for title, s in own.items()]
    done = to_markdown(pages, spark.createDataFrame(known, "lang string, title string, slug string"))
    return render_notes(done), Counter({r.name: r.n for r in dropped_tally(done).collect()}), got


def unattributed(notes: DataFrame, notice: str, sentinel: str = SENTINEL) -> DataFrame:
    """path of notes(path) that have no row in the notice behind its sentinel."""
    rows = [(x.partition(" | ")[0],) for x in notice.partition(sentinel)[2].splitlines() if x.strip()]
    return notes.select("path").join(notes.sparkSession.createDataFrame(rows, "path string"), "path", "left_anti")


def build_report(notes: int, got: Build, dropped: Counter, most: int = 10) -> str:
    """What a build did, for the console: notes, failures, and the templates that were dropped most."""
    lines = [f"{notes} notes written, {len(got.failures)} failures" + (", given up" if got.aborted else ""), *(f"  failed: {x}" for x in got.failures)]
    return "\n".join([*lines, *(f"  dropped {n:>6} {name}" for name, n in dropped.most_common(most))])


def build(spark: SparkSession, manifest: str, notice: str, root: str, get: Get = http_get, sleep: Callable[[float], None] = time.sleep) -> str:
    """Fetches what the manifest (a file) lists, writes the notes under root, brings manifest and notice up to date, and returns a report.

    What could not be fetched keeps its entry if its note is there from before; else the entry goes, as in reconcile."""
    from lodestone.sources.vault import write_notes

    rows = load_manifest(Path(manifest).read_text(encoding="utf-8"))
    notes, dropped, got = build_corpus(spark, rows, get, sleep)
    notes = checkpoint(notes)
    write_notes(notes, root)
    built = [{k: p[k] for k in ("cluster", "title", "lang", "revid")} for p in got.pages]
    kept = reconcile(rows, built, lambda path: (Path(root) / path).exists())
    Path(manifest).write_text(save_manifest(kept), encoding="utf-8")
    Path(notice).write_text(write_notice(Path(notice).read_text(encoding="utf-8"), notice_rows([r for r in kept if r["revid"] is not None])), encoding="utf-8")
    return build_report(notes.count(), got, dropped)
