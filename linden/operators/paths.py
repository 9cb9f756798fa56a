"""Paths, file types, ignore rules, link lists and keyword-cover scoring.

All per-row expressions: ignore rules are compiled into one ordered CASE
(last matching rule wins), so no join against the rule list is needed.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linden.functions.similarity import bound

# --- fixed values: file types --------------------------------------------------------
# Extensions (and special names) with a known file type; anything else falls
# back to the "rc" / "ignore" suffix rules, then to "default".
KNOWN_FILE_TYPES = (
    "gitignore", "license", "makefile", "lock",
    "ipynb", "py", "pyc", "pyd", "pyo", "pyw", "pyx", "pxd",
    "ai", "c", "cc", "class", "coffee", "cpp", "cs", "css", "dockerfile", "go",
    "htm", "html", "java", "js", "less", "php", "php3", "php4", "psd", "rb",
    "swift", "ts",
    "7z", "aac", "bat", "bin", "cmd", "cfg", "config", "csv", "db", "db2", "db3",
    "doc", "docx", "exe", "flac", "gif", "gz", "ico", "ini", "jpg", "jpeg",
    "json", "log", "map", "md", "mid", "midi", "mp3", "mp4", "o", "ogg", "png",
    "pkg", "ppt", "pptx", "rar", "rs", "rst", "svg", "sh", "so", "tar", "toml",
    "ttf", "txt", "wav", "woff", "woff2", "xls", "xlsx", "xml", "xz", "yaml",
    "zip",
)
RC_SUFFIX = "rc"
IGNORE_SUFFIX = "ignore"
DEFAULT_TYPE = "default"

# --- fixed values: link list ----------------------------------------------------------
LINK_LINE_PATTERN = r"^\*\s\[.*\]\(.*\) - .*$"
HOSTED_PREFIX = "https://github.com/"
ANCHOR_PATTERN = r'<a href="([^"]*)"'

# --- fixed values: file search scoring ---------------------------------------------
OPENED_BONUS = 10
PY_SUFFIX = ".py"


def url_path(url: Column) -> Column:
    """Path part of a URL: after scheme://host, without query / fragment."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def relative_parts(path: Column, root: str = "/") -> Column:
    """Parts of ``path`` relative to ``root`` (empty parts dropped); null when
    the path is not under the root."""
    rel = F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30))
    return F.filter(F.split(rel, "/", -1), lambda p: p != "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def file_type(name: Column) -> Column:
    """Type key of a file name: its lower-cased extension (text after the last
    dot, or the whole name) when known; else ``rc`` / ``ignore`` by suffix;
    else ``default``."""
    ext = F.lower(F.substring_index(name, ".", -1))
    known = F.array(*[F.lit(x) for x in KNOWN_FILE_TYPES])
    return (
        F.when(F.array_contains(known, ext), ext)
        .when(ext.endswith(RC_SUFFIX), F.lit(RC_SUFFIX))
        .when(ext.endswith(IGNORE_SUFFIX), F.lit(IGNORE_SUFFIX))
        .otherwise(F.lit(DEFAULT_TYPE))
    )


def glob_to_regex(rule: str) -> tuple[str, bool] | None:
    """One ignore-file line -> (anchored regex over a relative path, negated).
    Blank lines and comments give None.  Supports ``*``, ``**``, ``?``,
    ``[...]``, a leading ``/`` (root-anchored), a trailing ``/`` (directory)
    and ``!`` negation; a rule without an inner ``/`` matches at any depth."""
    line = rule.rstrip("\n").rstrip(" ")
    if not line or line.startswith("#"):
        return None
    neg = line.startswith("!")
    if neg:
        line = line[1:]
    dir_only = line.endswith("/")
    line = line.rstrip("/")
    anchored = line.startswith("/") or "/" in line
    line = line.lstrip("/")
    out = []
    i = 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if line.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            j = line.find("]", i + 1)
            if j < 0:
                out.append(r"\[")
            else:
                body = line[i + 1:j].replace("\\", "\\\\")
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + body + "]")
                i = j
        else:
            out.append(re.escape(c))
        i += 1
    body = "".join(out)
    head = "^" if anchored else "^(?:.*/)?"
    tail = "/.*$" if dir_only else "(?:/.*)?$"
    return head + body + tail, neg


def ignored(path: Column, rules: list[str]) -> Column:
    """True when the last rule matching ``path`` is not a negation."""
    compiled = [r for r in (glob_to_regex(x) for x in rules) if r is not None]
    expr = F.lit(False)
    for rx, neg in compiled:  # later rules wrap earlier ones: last match wins
        expr = F.when(path.rlike(rx), F.lit(not neg)).otherwise(expr)
    return expr


NEAREST_LEVELS = 5  # fixed value: a rule file counts this many folders up


def compiled_rules(files: DataFrame) -> DataFrame:
    """(dir, rules): rule files (dir, n, rule; a row per line) as arrays of
    (regex, neg) in line order; files without a rule in force stay, empty."""
    @F.pandas_udf("regex string, neg boolean")
    def compiled(rules: pd.Series) -> pd.DataFrame:
        found = [glob_to_regex(r or "") or (None, None) for r in rules]
        return pd.DataFrame(found, columns=["regex", "neg"])

    rows = files.select("dir", "n", compiled("rule").alias("r"))
    own = F.sort_array(F.collect_list(F.struct("n", "r.regex", "r.neg")))
    return rows.groupBy("dir").agg(F.filter(own, lambda r: r.regex.isNotNull()).alias("rules"))


def nearest_ignored(rels: DataFrame, files: DataFrame) -> DataFrame:
    """``rels`` (rel: a path relative to the top folder, ...) with ``rule_dir``
    and ``ignored``: the rule file of the nearest folder above the path, at
    most ``NEAREST_LEVELS`` folders up, decides alone; its last rule that fits
    the path below that folder wins, and without one nothing is ignored.

    Paths look their folders up (five keys each at most, folders once for all
    their paths) and keep the longest that has rules: two equi-joins on
    folders.  A null path is not ignored; the top folder is the empty string."""
    folder = F.regexp_replace("rel", "/?[^/]*$", "")
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/", -1))
    rows = rels.withColumns({"_folder": folder, "_parts": parts})
    levels = F.sequence(F.greatest(F.size("_parts") - NEAREST_LEVELS + 1, F.lit(0)), F.size("_parts"))
    above = rows.select("_folder", "_parts").distinct().select("_folder", F.explode(F.transform(levels, lambda n: F.array_join(F.slice("_parts", 1, n), "/"))).alias("dir"))
    rules = compiled_rules(files)
    near = above.join(rules.select("dir"), "dir").groupBy("_folder").agg(F.max_by("dir", F.length("dir")).alias("rule_dir"))
    ruled = near.join(rules.withColumnRenamed("dir", "rule_dir"), "rule_dir")
    below = F.when(F.col("rule_dir") == "", F.col("rel")).otherwise(F.substring("rel", F.length("rule_dir") + 2, F.length("rel")))
    ignored = F.aggregate("rules", F.lit(False), lambda last, r: F.when(F.rlike(below, r.regex), ~r.neg).otherwise(last))
    return rows.join(ruled, "_folder", "left").select(*[rels[c] for c in rels.columns], "rule_dir", F.coalesce(ignored, F.lit(False)).alias("ignored"))


def markdown_links(lines: DataFrame) -> DataFrame:
    """(doc_id, line, name, url, hosted) for ``* [name](url) - text`` lines:
    url between the first ``(`` and the first ``)``, name between the first
    ``[`` and the first ``]``."""
    t = F.col("text")
    d = lines.where(t.rlike(LINK_LINE_PATTERN))
    url = F.expr("substring(text, instr(text, '(') + 1, instr(text, ')') - instr(text, '(') - 1)")
    name = F.expr("substring(text, instr(text, '[') + 1, instr(text, ']') - instr(text, '[') - 1)")
    return d.select("doc_id", "line", name.alias("name"), url.alias("url"),
                    url.startswith(HOSTED_PREFIX).alias("hosted"))


def anchor_links(pages: DataFrame) -> DataFrame:
    """(page_id, i, href): every anchor target of a page, in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR_PATTERN), 1)).alias("i", "href"))


def _literal_cover(low: Column, k: Column) -> Column:
    """ARRAY<STRING>, a "1" for each character of ``low`` within one of the
    non-overlapping occurrences of ``k`` (each search resumes after the
    previous hit) and a "0" for each of the others."""
    pieces = F.split(low, F.concat(F.lit(r"\Q"), k, F.lit(r"\E")), -1)
    marks = F.call_function("array_join", F.transform(pieces, lambda p: F.repeat(F.lit("0"), F.length(p))), F.repeat(F.lit("1"), F.length(k)))
    return F.split(marks, "", -1)


def cover_mask(target: Column, keywords: Column) -> Column:
    """ARRAY<BOOLEAN>: character i is covered by an occurrence of a keyword
    (case-insensitive; empty keywords ignored)."""
    low = F.lower(target)
    kws = F.filter(F.transform(keywords, lambda k: F.lower(k)), lambda k: F.length(k) > 0)
    n = F.length(target)
    # The marks of all keywords are found once, not again for each character.
    return F.when(n == 0, F.array().cast("array<boolean>")).otherwise(bound(
        F.transform(kws, lambda k: _literal_cover(low, k)),
        lambda marks: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.exists(marks, lambda m: F.coalesce(F.get(m, i) == "1", F.lit(False))))))


def cover_display(target: Column, mask: Column) -> Column:
    """Target with covered runs wrapped in ``<em>`` tags."""
    n = F.length(target)
    pieces = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.concat(
            F.when(F.get(mask, i) & ~F.coalesce(F.get(mask, i - 1), F.lit(False)), F.lit("<em>"))
            .when(~F.get(mask, i) & F.coalesce(F.get(mask, i - 1), F.lit(False)), F.lit("</em>"))
            .otherwise(F.lit("")),
            F.substring(target, i + 1, 1),
        ),
    )
    body = F.when(n == 0, F.lit("")).otherwise(F.array_join(pieces, ""))
    return F.concat(body, F.when(F.coalesce(F.get(mask, n - 1), F.lit(False)), F.lit("</em>")).otherwise(F.lit("")))


def keyword_cover(df: DataFrame, col: str, keywords: list[str], opened: Column | None = None) -> DataFrame:
    """Add ``display`` and ``score`` = covered characters + 1 for ``.py`` +
    10 for opened files."""
    kws = F.array(*[F.lit(k) for k in keywords]) if keywords else F.array().cast("array<string>")
    d = df.withColumn("_mask", cover_mask(F.col(col), kws))
    covered = F.size(F.filter("_mask", lambda x: x))
    bonus = F.col(col).endswith(PY_SUFFIX).cast("int")
    if opened is not None:
        bonus = bonus + F.when(opened, F.lit(OPENED_BONUS)).otherwise(F.lit(0))
    d = d.withColumn("_covered", covered)
    return d.withColumn("display", cover_display(F.col(col), F.col("_mask"))).withColumn(
        "score", F.col("_covered") + bonus).drop("_mask", "_covered")
