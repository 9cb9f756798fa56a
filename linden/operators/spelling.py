"""Spell checking of identifiers, strings and comments over a token table.

The reference walks one file's tokens in order with a set of already-checked
items and a set of imported names.  Here every order-dependent test becomes a
comparison against the *first position* of an item, computed by a grouped
``min`` (partial aggregation, skew-safe):

* an identifier is checked only at its first occurrence as a checked item;
* a word counts as correct once it has been checked earlier anywhere in the
  file;
* an imported name counts only after its import.

Scopes (``for`` targets, ``def`` parameters, ``import`` lists) are toggles
carried over the token stream with blocked look-backs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linden.functions import lexicon as lx
from linden.functions.similarity import bound
from linden.operators import dictionary as dct
from linden.operators.lookup import BROADCAST_ROWS
from linden.operators.sequence import carry_last, last_before
from linden.session import materialize as write_once
from linden.sources import views

# --- fixed values: spelling ---------------------------------------------------------
MIN_PART_LEN = 3           # decomposed parts shorter than this are dropped
MIN_NAME_LEN_EXCLUSIVE = 3  # identifiers of 3 characters or fewer are not checked
MIN_WORD_LEN = 4           # string/comment words shorter than this are skipped
DECLARING_KEYWORDS = ("class", "as")
IMPORT_STOP = ("as", "from")
EM_OPEN = "<em>"
EM_CLOSE = "</em>"


def decompose(t: Column) -> Column:
    """Identifier -> lower-case words: split on ``[_\\d]+``; unless the joined
    parts are upper case, split camel humps; keep parts of 3+ characters."""
    parts = F.filter(F.split(t, r"[_\d]+", -1), lambda p: p != "")
    joined = F.array_join(parts, "")
    upper = (F.upper(joined) == joined) & (F.lower(joined) != joined)
    humps = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"[A-Z][a-z]*|[^A-Z]+"), 0)))
    chosen = F.when(upper, parts).otherwise(humps)
    return F.transform(F.filter(chosen, lambda p: F.length(p) >= MIN_PART_LEN), lambda p: F.lower(p))


def string_words(t: Column) -> Column:
    """Words of a string or comment token: runs of letters."""
    return F.regexp_extract_all(t, F.lit(r"\p{L}+"), 0)


def with_neighbours(tokens: DataFrame) -> DataFrame:
    """Add t1 (previous token in the line, '' for the first) and kind1."""
    w = Window.partitionBy("doc_id", "line").orderBy("pos")
    return (
        tokens.withColumn("t1", F.coalesce(F.lag("t").over(w), F.lit("")))
        .withColumn("kind1", F.lag("kind").over(w))
    )


def scope_flags(tokens: DataFrame) -> DataFrame:
    """(doc_id, line, pos, kind, t, t1, kind1, for_, def_, import_) per token.

    ``for_`` is on after ``for`` until ``in``; ``def_`` after ``def`` until a
    ``:`` that follows ``)``; both carry across lines.  ``import_`` is on
    after ``import`` until ``as`` / ``from`` or the end of the line."""
    d = with_neighbours(tokens)
    order = F.col("line").cast("long") * F.lit(1 << 31) + F.col("pos").cast("long")
    d = d.withColumn("_o", order)
    blk = F.floor(F.col("line") / 2048)
    for_t = F.when(F.col("t1") == "for", F.lit(True)).when(F.col("t") == "in", F.lit(False))
    def_t = F.when(F.col("t1") == "def", F.lit(True)).when((F.col("t") == ":") & (F.col("t1") == ")"), F.lit(False))
    d = carry_last(d, for_t, "for_", order="_o", block_col=blk, inclusive=True)
    d = carry_last(d, def_t, "def_", order="_o", block_col=blk, inclusive=True)
    imp_t = F.when(F.col("t1") == "import", F.lit(True)).when(F.col("t").isin(*IMPORT_STOP), F.lit(False))
    wl = Window.partitionBy("doc_id", "line").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("import_", F.last(imp_t, ignorenulls=True).over(wl))
    return d.select(
        "doc_id", "line", "pos", "kind", "t", "t1", "kind1",
        F.coalesce("for_", F.lit(False)).alias("for_"),
        F.coalesce("def_", F.lit(False)).alias("def_"),
        F.coalesce("import_", F.lit(False)).alias("import_"),
    )


def _token_stream(toks: Column) -> Column:
    """ARRAY<STRUCT<line, pos, t, t1>> of the tokens ARRAY<ARRAY<STRING>> of a document's lines."""
    return F.flatten(F.transform(toks, lambda ts, i: F.transform(ts, lambda t, k: F.struct(
        i.alias("line"), k.alias("pos"), t.alias("t"), F.coalesce(F.get(ts, k - 1), F.lit("")).alias("t1")))))


def _flag_arrays(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` (doc_id, codes, ...) prepared, and the expression of the tokens
    of a document in order with their scope flags.  The last toggle up to each
    token is found by index, so nothing is shuffled or windowed.  (The tokens
    are no column: the optimizer would filter documents by one that is
    exploded, and put what it is computed from into its lambdas for that.)"""
    kept = [c for c in docs.columns if c != "codes"]
    d = docs.select(*kept, _token_stream(F.transform("codes", views.line_tokens)).alias("_a"))

    def last(toggles) -> Column:  # index of the last token up to each one that toggles
        marks = F.filter(F.transform("_a", lambda x, i: F.when(toggles(x), i)), lambda i: i.isNotNull())
        return last_before(marks, F.size("_a") + 1)

    d = d.select(*kept, "_a", last(lambda x: (x["t1"] == "for") | (x["t"] == "in")).alias("_f"),
                 last(lambda x: (x["t1"] == "def") | ((x["t"] == ":") & (x["t1"] == ")"))).alias("_d"),
                 last(lambda x: (x["t1"] == "import") | x["t"].isin(*IMPORT_STOP)).alias("_i"))

    def on(marks: Column, i: Column, word: str, line: Column | None = None) -> Column:
        def opened(m):  # by its own toggle, for imports on this line
            x = F.get(F.col("_a"), m)
            return F.coalesce((x["t1"] == word) & (F.lit(True) if line is None else x["line"] == line), F.lit(False))

        return bound(F.get(marks, i + 1), opened)

    # the indices are bound: inside the lambda alone they would be found again for each token
    return d, bound(F.struct("_f", "_d", "_i"), lambda m: F.transform("_a", lambda x, i: F.struct(
        x["line"].alias("line"), x["pos"].alias("pos"), x["t"].alias("t"), x["t1"].alias("t1"),
        on(m["_f"], i, "for").alias("for_"), on(m["_d"], i, "def").alias("def_"), on(m["_i"], i, "import", x["line"]).alias("import_"))))


def document_scope_flags(docs: DataFrame) -> DataFrame:
    """``scope_flags`` of documents (doc_id, codes), without a shuffle."""
    d, tokens = _flag_arrays(docs)
    d = d.select("doc_id", F.explode(tokens).alias("x")).select("doc_id", "x.*")
    return d.select("doc_id", "line", "pos", views.token_kind(F.col("t")).alias("kind"), "t", "t1",
                    F.when(F.col("t1") != "", views.token_kind(F.col("t1"))).alias("kind1"), "for_", "def_", "import_")


def check_events(flags: DataFrame) -> DataFrame:
    """(doc_id, line, pos, action, ct, ckind): what each token step checks.
    ``self`` checks the token, ``prev`` the token before ``=``, ``import``
    records an imported name."""
    action = _action({c: F.col(c) for c in ("t", "t1", "for_", "def_", "import_")}, F.col("kind").isin(lx.KIND_STRING, lx.KIND_COMMENT))
    d = flags.withColumn("action", action).where(F.col("action").isNotNull())
    ct = F.when(F.col("action") == "prev", F.col("t1")).otherwise(F.col("t"))
    ck = F.when(F.col("action") == "prev", F.col("kind1")).otherwise(F.col("kind"))
    return d.select("doc_id", "line", "pos", "action", ct.alias("ct"), ck.alias("ckind"))


def _action(x, is_text: Column) -> Column:
    return (
        F.when(x["t1"].isin(*DECLARING_KEYWORDS), F.lit("self"))
        .when(x["def_"], F.lit("self"))
        .when(x["t"] == "=", F.lit("prev"))
        .when(x["for_"], F.lit("self"))
        .when(is_text, F.lit("self"))
        .when(x["import_"], F.lit("import"))
    )


def _ord(line: Column, pos: Column, sub: Column) -> Column:
    return F.struct(line.alias("l"), pos.alias("p"), sub.alias("s"))


def spelling(tokens: DataFrame, dictionary: DataFrame, materialize: bool = True, project: DataFrame | None = None) -> DataFrame:
    """(doc_id, line, pos, token, highlighted): identifiers (and string /
    comment words) with at least one unknown word, reported once.

    ``project`` (doc_id, w, line): words that a document's project dictionary
    was given at a line; each is accepted from that line on.

    The check events feed five branches (imports, names, string words, first
    positions, words); with ``materialize`` they are written once to the
    shared checkpoint folder instead of being recomputed per branch."""
    ev = check_events(scope_flags(tokens))
    if materialize:
        ev = write_once(ev, "spell-events")
    dict_words = dictionary.select("w").distinct()
    prefixes = dct.dictionary_prefixes(dictionary).withColumnRenamed("prefix", "w")

    # Imported names: lower-case token (unless a dictionary word) and its words.
    imp = ev.where(F.col("action") == "import").select(
        "doc_id", "line", "pos", F.col("ct").alias("t"))
    imp_items = imp.select("doc_id", "line", "pos", F.array_union(
        F.array(F.lower("t")), decompose(F.col("t"))).alias("ws"), F.lower("t").alias("lt"))
    imp_items = imp_items.join(dict_words.withColumnRenamed("w", "lt"), "lt", "left_anti")
    imported = imp_items.select("doc_id", F.explode("ws").alias("w"), _ord(F.col("line"), F.col("pos"), F.lit(0)).alias("o")) \
        .groupBy("doc_id", "w").agg(F.min("o").alias("imp_o"))

    names = ev.where((F.col("action") != "import") & (F.col("ckind") == lx.KIND_NAME)).select(
        "doc_id", "line", "pos", F.col("ct").alias("s"), F.lit(0).alias("sub"), F.lit(False).alias("from_text"))
    texts = ev.where((F.col("action") != "import") & F.col("ckind").isin(lx.KIND_STRING, lx.KIND_COMMENT)).select(
        "doc_id", "line", "pos", F.posexplode(string_words(F.col("ct"))).alias("sub", "s"))
    # A string word is checked only if it is lower-case, long enough, not a
    # dictionary word and not imported before it.
    texts = texts.where((F.length("s") >= MIN_WORD_LEN) & (F.lower("s") == F.col("s")) & (F.upper("s") != F.col("s")))
    texts = texts.join(dict_words.withColumnRenamed("w", "s"), "s", "left_anti")
    texts = texts.join(imported.withColumnRenamed("w", "s"), ["doc_id", "s"], "left") \
        .where(F.col("imp_o").isNull() | (F.col("imp_o") > _ord(F.col("line"), F.col("pos"), F.col("sub") + 1))) \
        .select("doc_id", "line", "pos", "s", (F.col("sub") + 1).alias("sub"), F.lit(True).alias("from_text"))
    if project is not None:
        accepted = project.groupBy("doc_id", "w").agg(F.min("line").alias("known_from"))
        texts = texts.join(accepted.withColumnRenamed("w", "s"), ["doc_id", "s"], "left") \
            .where(F.col("known_from").isNull() | (F.col("known_from") > F.col("line"))).drop("known_from")
    checks = names.unionByName(texts).where(F.length("s") > MIN_NAME_LEN_EXCLUSIVE)
    checks = checks.withColumn("o", _ord(F.col("line"), F.col("pos"), F.col("sub"))).withColumn("ws", decompose(F.col("s")))

    # First position of every checked item (tokens and their words).
    items = checks.select("doc_id", "o", F.explode(F.array_union(F.array(F.col("s")), F.col("ws"))).alias("item"))
    first = items.groupBy("doc_id", "item").agg(F.min("o").alias("first_o"))
    # The token itself must not have been checked before.
    checks = checks.join(first.select("doc_id", F.col("item").alias("s"), "first_o"), ["doc_id", "s"]) \
        .where(F.col("first_o") == F.col("o")).drop("first_o")

    words = checks.select("doc_id", "line", "pos", "sub", "o", "s", F.posexplode("ws").alias("wi", "w"))
    words = (
        words.join(dict_words.withColumn("in_dict", F.lit(True)), "w", "left")
        .join(prefixes.withColumn("is_prefix", F.lit(True)), "w", "left")
        .join(imported, ["doc_id", "w"], "left")
        .join(first.select("doc_id", F.col("item").alias("w"), F.col("first_o").alias("w_first")), ["doc_id", "w"], "left")
    )
    ok = (
        F.coalesce(F.col("in_dict"), F.lit(False))
        | F.coalesce(F.col("is_prefix"), F.lit(False))
        | F.coalesce(F.col("imp_o") < F.col("o"), F.lit(False))
        | F.coalesce(F.col("w_first") < F.col("o"), F.lit(False))
    )
    if project is not None:
        words = words.join(accepted, ["doc_id", "w"], "left")
        ok = ok | F.coalesce(F.col("known_from") <= F.col("line"), F.lit(False))
    words = words.withColumn("ok", ok)
    per_token = words.groupBy("doc_id", "line", "pos", "sub", "s").agg(
        F.sort_array(F.collect_list(F.struct("wi", "w", "ok"))).alias("wl"))
    bad = per_token.where(F.exists("wl", lambda x: ~x["ok"]))
    return bad.select("doc_id", "line", "pos", "sub", F.col("s").alias("token"),
                      highlight_words(F.col("s"), F.col("wl")).alias("highlighted"))


# tags of a document's items: checked here, imported here, in the project dictionary from here on
CHECKED, IMPORTED, ADDED = 0, 1, 2


def _item(item: Column, tag: int, x: Column, sub: Column, s: Column) -> Column:
    return F.struct(item.alias("item"), F.lit(tag).alias("tag"), x["line"].alias("line"), x["pos"].alias("pos"), sub.alias("sub"), s.alias("s"))


def _is_text(t: Column) -> Column:
    """A comment or string token."""
    return t.startswith("#") | ((F.length(t) >= 2) & (t.startswith('"') | t.startswith("'")))


def _event_items(x: Column) -> Column:
    """The items of a token that is checked or imported: the words of a text, or a name and its words."""
    none = F.array().cast("array<struct<item:string,tag:int,line:int,pos:int,sub:int,s:string>>")

    def named(t, tag, s):
        return F.transform(F.array_union(F.array(s), decompose(t)), lambda w: _item(w, tag, x, F.lit(0), s))

    def words(t):
        found = F.transform(string_words(t), lambda w, k: F.struct(w.alias("w"), (k + 1).alias("k")))
        kept = F.filter(found, lambda y: (F.length(y["w"]) >= MIN_WORD_LEN) & (F.lower(y["w"]) == y["w"]) & (F.upper(y["w"]) != y["w"]))
        return F.transform(kept, lambda y: _item(y["w"], CHECKED, x, y["k"], y["w"]))

    def of(y):
        ct = y["ct"]
        return (
            F.when(y["action"] == "import", named(ct, IMPORTED, F.lower(ct)))
            .when(_is_text(ct), words(ct))
            .when(ct.rlike(r"^[\p{L}_]") & (F.length(ct) > MIN_NAME_LEN_EXCLUSIVE), named(ct, CHECKED, ct))
            .otherwise(none))

    action = _action(x, _is_text(x["t"]))
    return bound(action, lambda a: F.when(a.isNull(), none).otherwise(
        bound(F.struct(a.alias("action"), F.when(a == "prev", x["t1"]).otherwise(x["t"]).alias("ct")), of)))


def _first_items(docs: DataFrame) -> DataFrame:
    """(doc_id, _f): the first check of every item of a document: ``ok`` if an
    import or the project dictionary makes it right there, else ``via``: the
    import tokens that make it right unless they are dictionary words.

    A text's word that the dictionary, an import or the project dictionary
    knows need not be left out beforehand: it is right itself, and whatever it
    would be the first occurrence of is right for the same reason."""
    d, tokens = _flag_arrays(docs)
    items = F.flatten(F.transform(tokens, _event_items))
    if "project" in docs.columns:
        added = F.transform("project", lambda p: _item(p["w"], ADDED, F.struct(p["line"].cast("int").alias("line"), F.lit(0).alias("pos")), F.lit(0), F.lit(None).cast("string")))
        items = F.concat(items, added)
    d = d.select("doc_id", F.sort_array(items).alias("_e"))
    e = F.col("_e")
    starts = F.filter(F.transform("_e", lambda x, i: F.when((i == 0) | (x["item"] != F.get(e, i - 1)["item"]), i)), lambda i: i.isNotNull())
    d = d.select("doc_id", "_e", starts.alias("_at"))
    no_via = F.array().cast("array<string>")

    def first(b, k):
        end = F.coalesce(F.get(F.col("_at"), k + 1), F.size("_e"))
        f = F.get(e, b)
        more = F.get(e, end - 1)["tag"] != CHECKED

        def known(run):
            before = F.filter(run, lambda x: (x["tag"] == IMPORTED) & (F.struct(x["line"], x["pos"], x["sub"]) < F.struct(f["line"], f["pos"], f["sub"])))
            given = F.exists(run, lambda x: (x["tag"] == ADDED) & (x["line"] <= f["line"]))
            ok = given | F.exists(before, lambda x: x["s"] == x["item"])
            return F.struct(ok.alias("ok"), F.when(ok, no_via).otherwise(F.array_distinct(F.transform(before, lambda x: x["s"]))).alias("via"))

        judged = F.when(more, bound(F.slice(e, b + 1, end - b), known)).otherwise(F.struct(F.lit(False).alias("ok"), no_via.alias("via")))
        return F.when(f["tag"] == CHECKED, bound(judged, lambda j: F.struct(
            f["line"].alias("line"), f["pos"].alias("pos"), f["sub"].alias("sub"), f["s"].alias("s"), f["item"].alias("item"), j["ok"].alias("ok"), j["via"].alias("via"))))

    return d.select("doc_id", F.filter(F.transform("_at", first), lambda x: x.isNotNull()).alias("_f"))


def document_checks(docs: DataFrame) -> DataFrame:
    """(doc_id, line, pos, sub, s, wl ARRAY<STRUCT<wi, w, ok, via>>): the tokens
    and words of documents (doc_id, codes, project if there is one) that are
    checked, with their words, without a shuffle; those are left out of which no
    word is new."""
    d = _first_items(docs)
    new = lambda x, wl: F.struct(*[x[k].alias(k) for k in ("line", "pos", "sub", "s")], wl.alias("wl"))
    texts = F.transform(F.filter("_f", lambda x: (x["sub"] > 0) & ~x["ok"]), lambda x: new(x, F.array(
        F.struct(F.lit(0).alias("wi"), x["item"].alias("w"), F.lit(False).alias("ok"), x["via"].alias("via")))))
    d = d.select("doc_id", texts.alias("_t"), F.sort_array(F.filter("_f", lambda x: x["sub"] == 0)).alias("_n"))
    n, same = F.col("_n"), lambda x, y: (x["line"] == y["line"]) & (x["pos"] == y["pos"])
    starts = F.filter(F.transform("_n", lambda x, i: F.when((i == 0) | ~same(x, F.get(n, i - 1)), i)), lambda i: i.isNotNull())
    runs = bound(starts, lambda at: F.transform(at, lambda b, k: F.slice(n, b + 1, F.coalesce(F.get(at, k + 1), F.size(n)) - b)))
    no_via = F.array().cast("array<string>")

    def words(run):  # a word that is not among the first ones of its token was checked before
        return F.transform(decompose(F.get(run, 0)["s"]), lambda w, wi: bound(F.get(F.filter(run, lambda x: x["item"] == w), 0), lambda f: F.struct(
            wi.alias("wi"), w.alias("w"), F.coalesce(f["ok"], F.lit(True)).alias("ok"), F.coalesce(f["via"], no_via).alias("via"))))

    kept = F.filter(runs, lambda run: F.exists(run, lambda x: x["item"] == x["s"]))
    names = F.filter(F.transform(kept, lambda run: new(F.get(run, 0), words(run))), lambda x: F.exists(x["wl"], lambda w: ~w["ok"]))
    return d.select("doc_id", F.explode(F.concat("_t", names)).alias("x")).select("doc_id", "x.*")


def document_spelling(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``spelling`` of documents (doc_id, codes, project if there is one).  The
    words of the dictionary and their beginnings are written and, up to
    ``BROADCAST_ROWS``, sent to the checks; only tokens of several words are
    brought together again by a shuffle."""
    def sent(df: DataFrame, name: str) -> DataFrame:
        df = write_once(df, name)
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    words = dictionary.select("w").distinct()
    known = sent(words.union(dct.dictionary_prefixes(dictionary)).distinct(), "spell-known")
    first = F.get("wl", 0)
    single = (F.size("wl") == 1) & (first["w"] == F.col("s")) & (F.size(first["via"]) == 0)
    checks = write_once(document_checks(docs).withColumn("wl", F.when(~single, F.col("wl"))), "spell-checks")
    single = F.col("wl").isNull()  # a token that is its one word, which nothing in the document makes right
    alone = checks.where(single).select("doc_id", "line", "pos", "sub", F.col("s").alias("w")).join(known, "w", "left_anti") \
        .select("doc_id", "line", "pos", "sub", F.col("w").alias("token"), F.concat(F.lit(EM_OPEN), "w", F.lit(EM_CLOSE)).alias("highlighted"))
    key = ["doc_id", "line", "pos", "sub", "s"]
    d = checks.where(~single).select(*key, F.explode("wl").alias("x")).select(*key, "x.wi", "x.w", "x.ok", F.explode_outer("x.via").alias("lt"))
    d = d.join(known.withColumn("_known", F.lit(True)), "w", "left").join(
        sent(words, "spell-words").select(F.col("w").alias("lt"), F.lit(True).alias("_word")), "lt", "left")
    ok = F.col("ok") | F.col("_known").isNotNull() | (F.col("lt").isNotNull() & F.col("_word").isNull())
    d = d.groupBy(*key).agg(F.collect_list(F.struct("wi", "w", ok.alias("ok"))).alias("_l"))
    wl = F.transform(F.sort_array(F.array_distinct(F.transform("_l", lambda x: F.struct(x["wi"].alias("wi"), x["w"].alias("w"))))), lambda x: F.struct(
        x["wi"].alias("wi"), x["w"].alias("w"), F.exists("_l", lambda y: (y["wi"] == x["wi"]) & y["ok"]).alias("ok")))
    bad = d.select(*key, wl.alias("wl")).where(F.exists("wl", lambda x: ~x["ok"]))
    return alone.unionByName(bad.select("doc_id", "line", "pos", "sub", F.col("s").alias("token"), highlight_words(F.col("s"), F.col("wl")).alias("highlighted")))


def highlight_words(token: Column, wl: Column) -> Column:
    """Wrap the incorrect words of a token in ``<em>`` tags, searching each
    word (case-insensitively) from where the previous one was found."""
    init = F.struct(token.alias("r"), F.lit(0).alias("i"))

    def step(acc, x):
        w = x["w"]
        rel = F.instr(F.lower(acc["r"]).substr(acc["i"] + 1, F.lit(1 << 30)), w)
        found = F.when(rel > 0, acc["i"] + rel - 1).otherwise(F.lit(-1))
        wrapped = F.concat(
            acc["r"].substr(F.lit(1), found),
            F.lit(EM_OPEN), acc["r"].substr(found + 1, F.length(w)),
            F.lit(EM_CLOSE), acc["r"].substr(found + 1 + F.length(w), F.lit(1 << 30)),
        )
        return F.when(x["ok"], F.struct(acc["r"].alias("r"), found.alias("i"))).otherwise(
            F.struct(wrapped.alias("r"), (found + 9).alias("i")))

    return F.aggregate(wl, init, step, lambda acc: acc["r"])
