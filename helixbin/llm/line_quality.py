r"""Line-first cleaning: every line is judged by itself, failing lines go, then documents that lost too much.

Words are ``[^\x20\x09-\x0D]+``. A line with a word fails by one of these rules:

* punctuation: it doesn't end with a terminal mark (``.!?…。！？؟।``), perhaps followed by closing quotes or brackets;
* symbols: at least a quarter of its words end with, or are, symbols (``#*$%&|<>``), or a word of it
  is a run of four or more symbols;
* navigation: at least three separators (``|``, ``»``, ``›``, ``·``, ``•``) and one for every six words or more;
* boilerplate: in a line of at most 40 words, one of the phrases of ``BOILERPLATE``, or the line itself is common: it stands
  between different neighbours in at least ``MIN_CONTEXTS`` places of the corpus and in one for every ``DOCS_A_CONTEXT`` documents. Where
  common lines hold more than half of a text, the text is a copy, which is not for this operator to judge, and they stay;
* repetition: the same line stood earlier in the text.

A document is kept if it passes the base rule (ten words, at most a fifth of them in repeated five-word
windows) and its kept lines hold more than half of its word characters. Null and empty texts have no word and are not kept; very
long texts are judged whole, in their row. Repeated rows count as documents each. An empty table gives no rows; other columns pass through
``judged``. Only built-in expressions are used: no text moves, the corpus' lines are counted as 64-bit hashes of them and their neighbours.
At most one line in ``DOCS_A_CONTEXT`` a document can be common, so their list, a scalar of the plan, is bounded by the length of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Fixed values.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SYMBOL_WORD = r"[#*$%&|<>](?=[\x20\x09-\x0D]|\z)"
SEPARATOR = r"[|»›·•]"
SYMBOL_RUN = r"[#*$%&|<>]{4}"
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "accept cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "skip to content",
    "click here to subscribe",
    "sign up for our newsletter",
    "lorem ipsum",
)
TERMINAL = r"""[.!?…。！？؟।]["'”’»)\]」』]*[\x20\x09-\x0D]*\z"""
MIN_CONTEXTS = 10
DOCS_A_CONTEXT = 2000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_KEPT_PERCENT = 50


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def windows(words: Column) -> Column:
    """A 64-bit key of each five-word window."""
    return F.when(
        F.size(words) >= 5,
        F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(5)))),
    ).otherwise(F.array().cast("array<bigint>"))


def covered(keys: Column) -> Column:
    """How many words stand in windows whose key occurs twice or more; ``keys`` in window order."""
    def places(s: Column) -> Column:
        same = F.filter(s, lambda p, k: (F.get(s, k - 1)["x"] == p["x"]) | (F.get(s, k + 1)["x"] == p["x"]))
        return F.array_sort(F.transform(same, lambda p: p["i"]))

    def total(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(5)), F.lit(5))), F.lit(0), lambda a, x: a + x)

    ordered = F.array_sort(F.transform(keys, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return let(ordered, lambda s: let(places(s), total))


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def common_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: ``common``, the hashes of the lines that stand between many different neighbours."""
    none = F.lit("\n")  # no line holds it
    around = lambda l, i: F.xxhash64(F.coalesce(F.get(l, i - 1), none), F.coalesce(F.get(l, i + 1), none))
    pairs = let(lines_of(F.col(text_col)), lambda l: F.transform(l, lambda x, i: F.struct(F.xxhash64(x).alias("h"), around(l, i).alias("c"))))
    seen = docs.select(F.explode(pairs).alias("p")).select("p.h", "p.c").distinct().groupBy("h").agg(F.count("*").alias("n"))
    return seen.where(F.col("n") >= max(MIN_CONTEXTS, -(-docs.count() // DOCS_A_CONTEXT))).agg(F.sort_array(F.collect_list("h")).alias("common"))


def line_fails(line: Column, n_words: Column, common: Column) -> Column:
    low = F.lower(line)
    boiler = F.array_contains(common, F.xxhash64(line))
    for phrase in BOILERPLATE:
        boiler = boiler | F.contains(low, F.lit(phrase))
    seps = F.regexp_count(line, F.lit(SEPARATOR))
    return (
        ~line.rlike(TERMINAL)
        | (4 * F.regexp_count(line, F.lit(SYMBOL_WORD)) >= n_words)
        | line.rlike(SYMBOL_RUN)
        | ((seps >= 3) & (6 * seps >= n_words))
        | ((n_words <= 40) & boiler)
    )


def quality(text: Column, common: Column) -> Column:
    """Counts, the base verdict, what the line rules removed, and ``kept``, as a struct; ``common``: hashes of the text's common lines.

    Every intermediate value is bound by ``let``: a filter on a field that the optimizer moves below a projection
    then still computes each of them once.
    """
    n_words = lambda x: F.regexp_count(x, F.lit(WORD))
    chars = lambda x: F.length(F.regexp_replace(x, BLANK, "")).cast("long")
    total = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + chars(x))
    none = F.array().cast("array<bigint>")

    def parts(t: Column) -> Column:
        return F.struct(word_list(t).alias("w"), lines_of(t).alias("l"), F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("symbols"))

    def wider(p: Column) -> Column:
        return F.struct(windows(p["w"]).alias("h"), F.array_distinct(p["l"]).alias("u"), F.length(F.array_join(p["w"], "")).cast("long").alias("chars"))

    def boilerplate(p: Column, q: Column) -> Column:
        held = total(F.filter(p["l"], lambda x: F.array_contains(common, F.xxhash64(x))))
        return F.when(F.size(common) == 0, none).when(2 * held > q["chars"], none).otherwise(common)

    def counts(p: Column, q: Column, own: Column) -> Column:
        lost = total(F.filter(q["u"], lambda x: let(n_words(x), lambda n: line_fails(x, n, own))))
        uniq = F.when(F.size(q["u"]) < F.size(p["l"]), total(q["u"])).otherwise(q["chars"])
        return F.struct(
            F.size(p["w"]).cast("long").alias("n"),
            F.when(F.size(F.array_distinct(q["h"])) < F.size(q["h"]), covered(q["h"])).otherwise(F.lit(0)).cast("long").alias("rep"),
            (lost + q["chars"] - uniq).alias("removed"),
        )

    def verdict(p: Column, q: Column, own: Column, c: Column) -> Column:
        base = (c["n"] < MIN_WORDS) | (100 * c["rep"] > MAX_REPEAT_PERCENT * c["n"])
        return F.struct(
            c["n"].alias("n_words"),
            q["chars"].alias("word_chars"),
            p["symbols"].alias("n_symbols"),
            (F.size(p["l"]) - F.size(q["u"])).cast("long").alias("n_dup_lines"),
            c["rep"].alias("n_repeat_words"),
            base.alias("base_failed"),
            c["removed"].alias("removed_chars"),
            (~base & (100 * (q["chars"] - c["removed"]) > MIN_KEPT_PERCENT * q["chars"])).alias("kept"),
            own.alias("boilerplate"),
        )

    return let(
        F.coalesce(text, F.lit("")),
        lambda t: let(parts(t), lambda p: let(wider(p), lambda q: let(boilerplate(p, q), lambda own: let(counts(p, q, own), lambda c: verdict(p, q, own, c))))),
    )


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``quality``, see there; it replaces a column of that name. Common lines are those of ``docs``."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("quality", "_common")]
    hashes = F.transform(lines_of(F.coalesce(text_col, F.lit(""))), lambda x: F.xxhash64(x))
    own = docs.select(*kept, F.array_intersect(hashes, common_lines(docs, text_col).scalar()).alias("_common"))
    return own.select(*kept, quality(F.col(text_col), F.col("_common")).alias("quality"))


def cleaned_text(text: Column, own: Column) -> Column:
    """The text without its failing lines and without later copies of a line; blank lines stay. ``own``: ``quality.boilerplate``."""

    def fails(x: Column) -> Column:
        return let(F.regexp_count(x, F.lit(WORD)), lambda n: line_fails(x, n, own))

    def kept(lines: Column) -> Column:
        # The first of equal lines: a stable order by line, then by place.
        ordered = F.array_sort(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        first = lambda s: F.filter(s, lambda p, k: ~p["x"].rlike(WORD) | ((k == 0) | (F.get(s, k - 1)["x"] != p["x"])) & ~fails(p["x"]))
        return F.transform(F.array_sort(F.transform(let(ordered, first), lambda p: F.struct(p["i"], p["x"]))), lambda p: p["x"])

    return F.array_join(let(F.split(text, "\n", -1), kept), "\n")


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``documents``."""
    return judged(documents.select("doc_id", "text")).select(
        "doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars"))
    )


def oracle() -> str:
    """The same rows in DuckDB's SQL."""
    terminal = "'" + TERMINAL.replace("'", "''") + "'"
    boiler = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT rid, unnest(generate_series(1, len(ws) - 4)) AS i, ws FROM w WHERE len(ws) >= 5),
k AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS win FROM g),
r AS (SELECT rid, i FROM k QUALIFY count(*) OVER (PARTITION BY rid, win) >= 2),
rep AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
lw AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
ln AS (SELECT rid, ls[i] AS line, coalesce(CASE WHEN i > 1 THEN ls[i-1] END, chr(10)) AS prev, coalesce(ls[i+1], chr(10)) AS nxt FROM (SELECT rid, ls, unnest(generate_series(1, len(ls))) AS i FROM lw)),
cm AS (SELECT line FROM ln GROUP BY line HAVING count(DISTINCT (prev, nxt)) >= greatest({MIN_CONTEXTS}, ceil((SELECT count(*) FROM documents) / {DOCS_A_CONTEXT}))),
wl AS (SELECT rid, line, count(*) AS c, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars, line IN (SELECT line FROM cm) AS common FROM ln GROUP BY rid, line),
cp AS (SELECT rid, 2 * coalesce(sum(c * chars) FILTER (common), 0) > sum(c * chars) AS copied FROM wl GROUP BY rid),
fl AS (SELECT wl.*, (NOT regexp_matches(line, {terminal}) OR 4 * len(regexp_extract_all(line, '[#*$%&|<>]([\\x20\\x09-\\x0D]|\\z)')) >= n OR regexp_matches(line, '[#*$%&|<>]{{4}}')
   OR (len(regexp_extract_all(line, '[|»›·•]')) >= 3 AND 6 * len(regexp_extract_all(line, '[|»›·•]')) >= n) OR (n <= 40 AND (common AND NOT copied OR {boiler}))) AS bad FROM wl JOIN cp USING (rid)),
la AS (SELECT rid, sum(c - 1) AS dup, sum(chars * (c - 1)) + coalesce(sum(chars) FILTER (bad), 0) AS lost FROM fl GROUP BY rid),
j AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
   CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS removed_chars FROM w LEFT JOIN rep USING (rid) LEFT JOIN la USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * (word_chars - removed_chars) > {MIN_KEPT_PERCENT} * word_chars AS kept, removed_chars FROM j"""
