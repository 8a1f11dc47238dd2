r"""Secret scan: a trigram inverted index picks candidates, the rules' regexes verify them.

1. ``trigram_query`` derives from a rule's regex a Boolean query over lower-case trigrams: a conjunction
   of clauses, each a disjunction of trigram sets. A regex without a mandatory trigram has no clause.
2. ``postings`` is the inverted index over the trigrams that any query names: (trigram, row).
3. ``candidates`` intersects postings: rows whose trigrams satisfy a rule's query.
4. ``find_secrets`` runs a rule's regex on its candidates only; rules without a query scan every text. Candidates, an id and a
   few bits each, go to the texts: they are broadcast up to a checked number of rows, and beyond it joined by id.

Everything is built-in DataFrame expressions. Case folding only widens the candidates, so the index loses
no match. A null or empty text has no spans; texts of any length are searched whole. Repeated rows, repeated ids and null ids each keep
their own row: postings of equal ids are pooled, which can only add candidates. Other columns pass through, whatever their names, but for
``secret_spans``, which is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, let

try:
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # Python 3.10 and before
    import sre_constants as _c
    import sre_parse as _p


@dataclass(frozen=True)
class Rule:
    """``group`` is what has to have ``min_chars``; 0 is the whole match."""

    kind: str
    regex: str
    group: int = 0
    min_chars: int = 0
    base: bool = False


#: The base kinds in their listed order, then further well-known token shapes.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

MAX_STRINGS = 96
#: Candidates (12 bytes each) that are broadcast at most.
BROADCAST_ROWS = 2_000_000


def _join(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= MAX_STRINGS else None


def _exact(node) -> set[str] | None:
    """All strings that a parsed node matches, if they are few."""
    op, arg = node
    if op is _c.LITERAL:
        return {chr(arg).lower()}
    if op is _c.IN:
        found = set()
        for kind, value in arg:
            if kind is _c.LITERAL:
                found.add(chr(value).lower())
            elif kind is _c.RANGE and value[1] - value[0] < 8:
                found |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is _c.SUBPATTERN:
        return _exact_all(arg[3])
    if op is _c.BRANCH:
        parts = [_exact_all(x) for x in arg[1]]
        return None if any(x is None for x in parts) or sum(map(len, parts)) > MAX_STRINGS else set().union(*parts)
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
        low, high, inner = arg
        one = _exact_all(inner)
        if one is None or high > 4:
            return None
        now, found = {""}, set() if low else {""}
        for k in range(1, high + 1):
            now = _join(now, one)
            if now is None:
                return None
            if k >= low:
                found |= now
        return found
    return {""} if op is _c.AT else None


def _exact_all(nodes) -> set[str] | None:
    now: set[str] | None = {""}
    for node in nodes:
        one = _exact(node)
        now = _join(now, one) if one is not None else None
        if now is None:
            return None
    return now


def _clause(strings: set[str]) -> frozenset[frozenset[str]] | None:
    """One of the strings has to be there; a string under three letters says nothing."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if not sets or frozenset() in sets:
        return None
    return frozenset(s for s in sets if not any(t < s for t in sets))


def _clauses(nodes) -> list[frozenset[frozenset[str]]]:
    found, now = [], {""}

    def flush() -> None:
        if (clause := _clause(now)) is not None:
            found.append(clause)

    for node in nodes:
        one = _exact(node)
        joined = _join(now, one) if one is not None else None
        if joined is not None:
            now = joined
            continue
        flush()
        now = one if one is not None else {""}
        if one is None:
            op, arg = node
            if op is _c.SUBPATTERN:
                found += _clauses(arg[3])
            elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0]:
                found += _clauses(arg[2])
    flush()
    return found


def trigram_query(regex: str) -> list[frozenset[frozenset[str]]]:
    """The Boolean trigram query of a regex: every clause holds, by one of its sets in full."""
    return list(dict.fromkeys(_clauses(list(_p.parse(regex)))))


def vocabulary(rules=RULES) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.regex) for s in clause for t in s})


def postings(texts: DataFrame, id_col: str, text_col: str, rules=RULES) -> DataFrame:
    """The inverted index over the queries' trigrams: ``trigram`` (its number in the vocabulary), ``id``."""
    words = vocabulary(rules)
    has = F.array(*(F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(i)) for i, t in enumerate(words)))
    return (
        texts.select(F.col(id_col).alias("id"), F.lower(text_col).alias("_low"))
        .where("_low IS NOT NULL")
        .select("id", F.explode(F.array_compact(has)).alias("trigram"))
    )


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """``id`` and ``rules`` (bits of the rules to verify), from the intersected postings."""
    words = {t: i for i, t in enumerate(vocabulary(rules))}
    if len(words) > 4 * 63:
        raise ValueError("too many trigrams for four words of bits")
    bits = [F.bit_or(F.when((F.col("trigram") >= 63 * k) & (F.col("trigram") < 63 * k + 63), F.expr(f"shiftleft(1L, trigram - {63 * k})")).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range((len(words) + 62) // 63)]
    rows = index.groupBy("id").agg(*bits)

    def whole(s: frozenset[str]) -> Column:
        test = F.lit(True)
        for k in range(len(bits)):
            mask = sum(1 << (words[t] - 63 * k) for t in s if 63 * k <= words[t] < 63 * k + 63)
            if mask:
                test = test & (F.col(f"b{k}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
        return test

    flags = F.lit(0)
    for r, rule in enumerate(rules):
        query = trigram_query(rule.regex)
        if not query:
            continue
        holds = F.lit(True)
        for clause in query:
            one = F.lit(False)
            for s in sorted(clause, key=sorted):
                one = one | whole(s)
            holds = holds & one
        flags = flags + F.when(holds, F.lit(1 << r)).otherwise(F.lit(0))
    return rows.select("id", flags.alias("rules")).where("rules <> 0")


#: Items that one array grows by before it is put aside, and code points of a block that texts are cut from: neither spans nor cuts cost more in long texts.
RUN, CUT = 128, 512


def _running(items: Column, kind: str, move, emit) -> Column:
    """``at`` after all items, starting from 0, and ``found``: the ``kind`` that ``emit(at, item)`` gives for each, an array of one or none.

    Items are taken in runs, so that no array is copied more than ``RUN`` times.
    """
    start = lambda at, of: F.struct(at.alias("at"), F.array().cast(of).alias("found"))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / F.lit(RUN)).cast("int") - 1, F.lit(0))), lambda i: F.slice(items, i * RUN + 1, RUN))
    inner = lambda acc, run: F.aggregate(run, start(acc["at"], f"array<{kind}>"), lambda a, x: F.struct(move(a["at"], x).alias("at"), F.concat(a["found"], emit(a["at"], x)).alias("found")))
    step = lambda acc, run: let(inner(acc, run), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["found"], F.array(r["found"])).alias("found")))
    return F.aggregate(runs, start(F.lit(0), f"array<array<{kind}>>"), step, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["found"]).alias("found")))


SPAN = "struct<s:int,k:int,e:int>"


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """All spans of a rule in a text: its gaps and matches alternate, so their lengths give the places."""
    matches = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    gaps = F.split(text, rule.regex, -1)
    group = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else matches
    parts = F.arrays_zip(F.transform(matches, F.length).alias("m"), F.transform(gaps, F.length).alias("g"), F.transform(group, F.length).alias("w"))
    end = lambda at, x: at + x["g"] + F.coalesce(x["m"], F.lit(0))
    span = lambda at, x: F.array(F.struct((at + x["g"]).alias("s"), F.lit(number).alias("k"), end(at, x).alias("e"))).cast(f"array<{SPAN}>")
    return let(parts, lambda p: _running(p, SPAN, end, lambda at, x: F.when(x["w"] >= rule.min_chars, span(at, x)).otherwise(F.array().cast(f"array<{SPAN}>"))))["found"]


def find_secrets(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Adds ``secret_spans`` array<struct<s,k,e>> (start and end in code points, end exclusive; k numbers the rule).

    Spans are ordered by start, then by the rules' order. Candidates come from the index; a rule without
    mandatory trigrams scans every text. Other columns pass through, whatever their names; an earlier ``secret_spans`` is replaced.
    """
    texts = texts.select(*(f"`{c}`" for c in texts.columns if c != "secret_spans"))
    own = {c: f"c{k}" for k, c in enumerate(texts.columns)}  # names that clash with nothing
    rows = texts.toDF(*own.values())
    found = Written(candidates(postings(rows, own[id_col], own[text_col], rules), rules).select(F.col("id").alias("candidate"), "rules")).df
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = rows.join(found, rows[own[id_col]].eqNullSafe(found["candidate"]), "left")
    text = F.col(own[text_col])
    each = []
    for r, rule in enumerate(rules):
        picked = F.col("rules").bitwiseAND(F.lit(1 << r)) != 0 if trigram_query(rule.regex) else F.lit(True)
        each.append(F.when(picked & text.rlike(rule.regex), _spans(text, r, rule)).otherwise(F.array().cast(f"array<{SPAN}>")).alias(f"k{r}"))
    rows = rows.select(*own.values(), *each)
    return rows.select(*own.values(), F.array_sort(F.concat(*(F.col(f"k{r}") for r in range(len(rules)))))).toDF(*own, "secret_spans")


def span_text(spans: Column, rules=RULES) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """Replaces each span of ``secret_spans`` by ``<SECRET>``; overlapping spans become one."""
    text, gap = F.col(f"`{text_col}`"), "struct<s:int,e:int>"
    none = F.array().cast(f"array<{gap}>")
    # The gaps between spans; a span that begins inside an earlier one opens none.
    gaps = _running(F.col("secret_spans"), gap, lambda at, x: F.greatest(at, x["e"]), lambda at, x: F.when(x["s"] >= at, F.array(F.struct(at.alias("s"), x["s"].alias("e"))).cast(f"array<{gap}>")).otherwise(none))

    def piece(blocks: Column, s: Column, e: Column) -> Column:
        first = F.floor(s / CUT).cast("int")
        last = F.floor(F.greatest(e - 1, s) / CUT).cast("int")

        def part(block: Column, i: Column) -> Column:
            at = (first + i) * CUT
            begin = F.greatest(s - at, F.lit(0))
            return F.substring(block, begin + 1, F.greatest(e - at - begin, F.lit(0)))

        return F.array_join(F.transform(F.slice(blocks, first + 1, last - first + 1), part), "")

    def whole(x: Column) -> Column:
        kept = F.transform(x["gaps"]["found"], lambda g: F.concat(piece(x["blocks"], g["s"], g["e"]), F.lit("<SECRET>")))
        return F.concat(F.array_join(kept, ""), piece(x["blocks"], x["gaps"]["at"], F.length(text)))

    parts = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)).alias("blocks"), gaps.alias("gaps"))
    return df.withColumn(text_col, F.when(F.size("secret_spans") > 0, let(parts, whole)).otherwise(text))


def report(documents: DataFrame, rules=RULES) -> DataFrame:
    """The contract's columns for every row of ``documents``."""
    base = [r for r, rule in enumerate(rules) if rule.base]
    rows = find_secrets(documents.select("doc_id", "text"), rules=rules)
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["k"] == k)).cast("long")
    names = {rule.kind: r for r, rule in enumerate(rules)}
    own = F.filter("secret_spans", lambda x: x["k"].isin(base))
    return rows.select(
        "doc_id",
        *(count(names[k]).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(span_text(own, rules), 256).alias("base_sha256"),
        span_text(F.col("secret_spans"), rules).alias("spans"),
    )


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle(rules=RULES) -> str:
    """The same rows in DuckDB's SQL, without the index."""
    parts = []
    for r, rule in enumerate(rules):
        regex = _sql_text(rule.regex)
        parts.append(
            f"SELECT rid, {r} AS k, '{rule.kind}' AS kind, unnest(list_transform(generate_series(1, len(m)), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'n': length(m[i]), 'w': length(w[i])}})) AS x, {rule.min_chars} AS least "
            f"FROM (SELECT rid, regexp_extract_all(t, {regex}, 0) AS m, string_split_regex(t, {regex}) AS g, regexp_extract_all(t, {regex}, {rule.group}) AS w FROM d WHERE regexp_matches(t, {regex}))"
        )
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), raw AS (" + " UNION ALL ".join(parts) + "), "
        "s AS (SELECT rid, k, kind, CAST(x.s AS BIGINT) AS b, CAST(x.s + x.n AS BIGINT) AS e FROM raw WHERE x.w >= least), "
        "a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, "
        "string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) FILTER (k < 3) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) AS spans FROM s GROUP BY rid) "
        "SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"
    )
