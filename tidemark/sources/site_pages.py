"""Posts out of raw web pages, by a table of rules for each site.

A rule names the elements of one list entry; a table function walks a page once and gives a row an entry, or
one row with an error.  What follows is relational: addresses are made absolute, local times become UTC, entries
of other hosts, old ones and repeats go.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.unicode import nfkc
from ..operators.keyed import distinct_on

#: source: the site's name; host: pages of this host and those below it; entry: selector of an entry; title, author, posted,
#: views, likes, comments: selectors within it (null: none); id: pattern whose first group is the id in an address
#: (null: the address is); zone: where its times are local; suffixes: endings that its titles lose.
RULE = "source string, host string, entry string, title string, author string, posted string, views string, likes string, comments string, id string, zone string, suffixes array<string>"
FIELDS = ("title", "author", "posted", "views", "likes", "comments")
VOID = set("area base br col embed hr img input link meta source track wbr".split())


class _Entries(HTMLParser):
    """Collects the text of the wanted elements (tag, tag.class or .class) within each entry, and its first link."""

    def __init__(self, entry: str, wanted: dict[str, str]) -> None:
        super().__init__(convert_charrefs=True)
        self.entry, self.wanted = _selector(entry), {k: _selector(v) for k, v in wanted.items() if v}
        self.open: list[str] = []
        self.found: list[dict[str, str]] = []
        self.inside = 0  # depth at which the present entry was opened
        self.fields: list[tuple[str, int]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        classes = set((given.get("class") or "").split())
        if tag not in VOID:
            self.open.append(tag)
        if not self.inside and _fits(self.entry, tag, classes):
            self.inside = len(self.open)
            self.found.append({})
        if self.inside:
            if tag == "a" and given.get("href"):
                self.found[-1].setdefault("href", given["href"])
            self.fields += [(k, len(self.open)) for k, s in self.wanted.items() if _fits(s, tag, classes) and k not in self.found[-1]]
            for k, _ in self.fields:
                self.found[-1].setdefault(k, "")

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open.pop() != tag:  # elements that were never closed end with the one around them
            pass
        self.fields = [(k, d) for k, d in self.fields if d <= len(self.open)]
        if self.inside > len(self.open):
            self.inside, self.fields = 0, []

    def handle_data(self, data: str) -> None:
        if self.inside:
            for k, _ in self.fields:
                self.found[-1][k] += data


def _selector(x: str) -> tuple[str, set[str]]:
    tag, *classes = x.split(".")
    return tag, set(classes)


def _fits(selector: tuple[str, set[str]], tag: str, classes: set[str]) -> bool:
    return selector[0] in ("", tag) and selector[1] <= classes


def count_of(x: str | None) -> int:
    """The number in a counter's text; 0 without one."""
    m = re.sub(r"[^0-9-]", "", x or "")
    return int(m) if re.fullmatch("-?[0-9]{1,18}", m) else 0


class PagePosts:
    """Table function: the entries of one page by one rule, or a row that says why there are none."""

    def eval(self, url: str, html: str, rule: object):  # noqa: ANN201
        if not (html or "").strip():
            yield (None,) * 8 + ("no page",)
            return
        try:
            parser = _Entries(rule["entry"], {k: rule[k] for k in FIELDS})
            parser.feed(html)
            parser.close()
            links = [urljoin(url or "", e["href"]) if e.get("href") else None for e in parser.found]
        except Exception as e:  # one bad page is a row of its own, not the end of the job
            yield (None,) * 8 + (f"{type(e).__name__}: {e}"[:200],)
            return
        if not parser.found:
            yield (None,) * 8 + ("no items parsed",)
        for e, link in zip(parser.found, links, strict=True):
            m = re.search(rule["id"], link) if rule["id"] and link else None
            yield (e.get("title"), link, m[1] if m else link, e.get("author"), e.get("posted"), count_of(e.get("views")), count_of(e.get("likes")), count_of(e.get("comments")), None)


POST = "title string, link string, external_id string, author string, posted string, views long, likes long, comments long, error string"


def posts_of(pages: DataFrame, rules: DataFrame, as_of: str | None = None, max_age_hours: int = 72, own_host: bool = False) -> DataFrame:
    """page_id, source, title, link, external_id, author, posted_at (UTC), views, likes, comments, error of the pages' entries.

    pages: page_id, url, html.  rules: see RULE; of several rules for a page's host the longest host counts, and a page
    without a rule gives no row.  With `as_of`, entries with a time more than `max_age_hours` before it go; with
    `own_host`, those that link to other hosts.  Entries without title or link go too.  An id that a source
    repeats stays once, in the page with the least id.  A page without entries gives one row with an error.
    """
    host = lambda c: F.lower(F.regexp_extract(c, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    p = pages.select("page_id", "url", "html", host(F.col("url")).alias("_host"))
    # Each host looks its rules up by itself and the names above it, an equi-join rather than a comparison with all rules.
    parts = F.split("_host", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = p.select("_host").distinct().select("_host", F.explode(above).alias("host"))
    known = distinct_on(hosts.join(rules, "host"), ["_host"], [F.desc(F.length("host")), F.col("source")])
    known = known.select("_host", F.struct(*(c.split()[0] for c in RULE.split(", "))).alias("rule"))
    met = p.join(known, "_host")
    made = F.udtf(PagePosts, returnType=POST)
    x = met.lateralJoin(made(F.col("url").outer(), F.col("html").outer(), F.col("rule").outer()))
    tidy = lambda c: F.trim(F.regexp_replace(nfkc(F.col(c)), "\\s+", " "))
    x = x.withColumns({"title": tidy("title"), "author": F.nullif(tidy("author"), F.lit("")), "posted": tidy("posted")})
    ending = F.aggregate(F.coalesce("rule.suffixes", F.array().cast("array<string>")), F.col("title"), lambda t, s: F.when(t.endswith(s), F.rtrim(F.substring(t, F.lit(1), F.length(t) - F.length(s)))).otherwise(t))
    local = F.coalesce(*(F.try_to_timestamp("posted", F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")))
    x = x.withColumn("title", ending).withColumn("posted_at", F.to_utc_timestamp(local, F.coalesce("rule.zone", F.lit("UTC"))))
    keep = (F.col("title") != "") & F.col("link").isNotNull()
    if own_host:
        keep = keep & (host(F.col("link")).endswith(F.col("rule.host")))
    if as_of:
        since = F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(max_age_hours))
        keep = keep & (F.col("posted_at").isNull() | (F.col("posted_at") >= since))
    shown = ["page_id", F.col("rule.source").alias("source"), "title", "link", F.substring("external_id", 1, 512).alias("external_id"), "author", "posted_at", "views", "likes", "comments", "error"]
    good = x.filter(F.col("error").isNull() & keep).select(*shown)
    once = distinct_on(good, ["source", "external_id"], [F.col("page_id"), F.col("title"), F.col("link")])
    return once.unionByName(x.filter("error is not null").select(*shown))
