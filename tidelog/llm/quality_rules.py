"""Quality rules: a threshold table compiled into one projection.

Each document's measures (lengths, symbols, stop words, line and repeat counts) and the
verdict of every rule come from built-in functions in a single narrow pass: no shuffle, no
Python, and one document's arrays are all that a task holds at a time.

Defined results for unusual input: a null or empty text has no words and all counts 0, so it
fails the word-count rule; repeated rows are each judged alike; an empty table gives an empty
table; other columns of the input are kept by :func:`quality_filter`, whatever their names,
because the measures stand in one struct column that is dropped at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import SPACE_CLASS, bound, free_name, space_words, without

#: Words that running prose of the four languages can't do without.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "on", "as", "was", "it", "by", "from",
    "der", "die", "das", "und", "von", "zu", "den", "mit", "für", "ist", "im", "auf", "des", "dem", "ein",
    "de", "la", "le", "les", "et", "que", "en", "un", "une", "du", "pour", "dans", "est", "sur", "par",
    "el", "los", "las", "del", "se", "una", "por", "con", "no", "al", "su", "y", "para", "es", "lo",
)
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes where 100 * left compares as stated with per_cent * right."""

    name: str
    left: str
    compare: str
    per_cent: int
    right: str = "one"

    def sql(self) -> str:
        """The condition, in words of Spark SQL and of DuckDB alike."""
        return f"100 * {self.left} {self.compare} {self.per_cent} * {self.right}"


#: The rules of the contract's base verdict.
BASE_RULES = (
    Rule("enough words", "n_words", ">=", 50 * 100),
    Rule("few repeated windows", "n_repeat_words", "<=", 50, "n_words"),
)
#: The method's rules: whole numbers, so that both engines agree to the last row. Of lines, 40 in 100
#: may repeat others: one in three is what a short text of three lines with a line said twice has.
RULES = (
    *BASE_RULES,
    Rule("words not too short", "word_chars", ">=", 150, "n_words"),
    Rule("words not too long", "word_chars", "<=", 1500, "n_words"),
    Rule("few symbols", "n_symbols", "<=", 10, "n_words"),
    Rule("few exclamation marks", "n_bangs", "<=", 15, "n_words"),
    Rule("some stop words", "n_stop_words", ">=", 2, "n_words"),
    Rule("few repeated lines", "n_dup_lines", "<=", 40, "n_lines"),
    Rule("few list lines", "n_list_lines", "<=", 90, "n_lines"),
    Rule("few cut lines", "n_cut_lines", "<=", 30, "n_lines"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_bangs", "n_list_lines", "n_cut_lines")


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(without(text, chars))).cast("long")


#: Windows of texts with fewer words than 2^16 are packed as 48 bits of hash and 16 of place.
PLACE_BITS = 16


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that stand twice or more in the text.

    Windows are sorted by hash with their place, so that equal ones are neighbours, and the words
    themselves are compared where hashes meet; each start of a repeated window then covers its three
    words, less what the next one covers. The hash only orders: how hash and place are kept (one long
    up to 2^16 words, whose sort is quick, a struct beyond) doesn't matter to the result.
    """
    n = F.size(words)
    return (
        F.when(n < 3, F.lit(0).cast("long"))
        .when(n < 1 << PLACE_BITS, _covered(words, _packed, lambda x: F.shiftright(x, PLACE_BITS), lambda x: x.bitwiseAND((1 << PLACE_BITS) - 1).cast("int")))
        .otherwise(_covered(words, lambda h, i: F.struct(h.alias("h"), i.alias("i")), lambda x: x["h"], lambda x: x["i"]))
    )


def _packed(h: Column, i: Column) -> Column:
    return F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long"))


def _covered(words: Column, pack: Callable, hash_of: Callable, place_of: Callable) -> Column:
    starts = F.sort_array(
        F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: pack(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), i),
        )
    )

    def equal(x: Column, y: Column) -> Column:
        i, j = place_of(x), place_of(y)
        windows = [F.get(words, i + k).eqNullSafe(F.get(words, j + k)) for k in range(3)]
        return hash_of(x).eqNullSafe(hash_of(y)) & windows[0] & windows[1] & windows[2]

    def repeated(s: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            before, after = F.get(s, i - 1), F.get(s, i + 1)
            met = hash_of(x).eqNullSafe(hash_of(after)) | hash_of(x).eqNullSafe(hash_of(before))
            # Other windows of the same hash may stand between equal ones.
            return F.when(equal(x, after) | equal(x, before), True).when(met, F.exists(s, lambda y: equal(x, y) & (place_of(x) != place_of(y)))).otherwise(False)

        return F.sort_array(F.transform(F.filter(s, twice), place_of))

    return F.aggregate(
        bound(starts, repeated),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )


def measures(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """docs with a struct column of the measures of MEASURES, all long."""
    def of(t: Column, w: Column, rows: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _count_of(t, SYMBOLS).alias("n_symbols"),
            (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(rows).cast("long").alias("n_lines"),
            F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            _count_of(t, "!").alias("n_bangs"),
            F.size(F.filter(rows, lambda x: x.startswith("- ") | x.startswith("* "))).cast("long").alias("n_list_lines"),
            F.size(F.filter(rows, lambda x: x.endswith("..."))).cast("long").alias("n_cut_lines"),
        )

    def with_lines(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return bound(space_words(t), lambda w: bound(lines, lambda rows: of(t, w, rows)))

    return docs.withColumn(out, bound(F.coalesce(F.col(text), F.lit("")), with_lines))


def passes(rules: tuple[Rule, ...], quality: str = "quality") -> Column:
    """True where all rules hold: one Boolean expression over the measures."""
    found = F.lit(True)
    for rule in rules:
        left, right = F.col(f"{quality}.{rule.left}"), F.lit(1) if rule.right == "one" else F.col(f"{quality}.{rule.right}")
        found = found & (100 * left >= rule.per_cent * right if rule.compare == ">=" else 100 * left <= rule.per_cent * right)
    return found


def failed_rules(rules: tuple[Rule, ...], quality: str = "quality") -> Column:
    """The names of the rules that a document fails, in the table's order."""
    return F.filter(F.array(*(F.when(~passes((r,), quality), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    out = free_name(docs, "quality")
    return measures(docs, out=out).where(passes(rules, out)).drop(out)


def op5_quality_rules(docs: DataFrame) -> DataFrame:
    """The contract's columns, then the names of the rules that failed."""
    base = passes(BASE_RULES)
    return measures(docs).select(
        "doc_id",
        *(F.col(f"quality.{m}").alias(m) for m in MEASURES[:5]),
        (~base).alias("base_failed"),
        (base & passes(RULES)).alias("kept"),
        F.array_join(failed_rules(RULES), ", ").alias("failed_rules"),
    )


def measures_sql(relation: str) -> str:
    """DuckDB SQL of the same measures: one row for each of the relation's rows."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
    WITH q0 AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {relation}),
    q1 AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACE_CLASS}'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM q0),
    q2 AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM q1),
    q3 AS (SELECT rid, i, word AS a, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM q2 WINDOW p AS (PARTITION BY rid ORDER BY i)),
    q4 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM q3 WHERE c IS NOT NULL),
    q5 AS (SELECT rid, count(DISTINCT i + d) AS n_repeat_words FROM q4, (VALUES (0), (1), (2)) v(d) WHERE n > 1 GROUP BY rid),
    q6 AS (SELECT q1.*, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE_CLASS}', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
        len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs,
        len(list_filter(l, lambda x: starts_with(x, '- ') OR starts_with(x, '* ')))::BIGINT AS n_list_lines,
        len(list_filter(l, lambda x: ends_with(x, '...')))::BIGINT AS n_cut_lines, 1 AS one
        FROM q1 LEFT JOIN q5 USING (rid))
    SELECT * EXCLUDE (rid, t, w, l) FROM q6"""


def passes_sql(rules: tuple[Rule, ...]) -> str:
    """The condition that all rules hold."""
    return " AND ".join(f"({r.sql()})" for r in rules)


OP5_SQL = f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    NOT ({passes_sql(BASE_RULES)}) AS base_failed, ({passes_sql(RULES)}) AS kept,
    array_to_string(list_filter([{", ".join(f"CASE WHEN NOT ({r.sql()}) THEN '{r.name}' END" for r in RULES)}], lambda x: x IS NOT NULL), ', ') AS failed_rules
FROM ({measures_sql("documents")})"""
