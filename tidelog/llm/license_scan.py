"""License scans: ordered signature rules over normalised words.

A text's words are its runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased. A few of
them are keywords; only texts that have one are matched, and then only with the rules of their own
keywords. A rule is a regular expression over the words, each written as ' word ', so that one
pattern serves any spacing and punctuation. Each match is an interval of words; a match inside
another's interval is dropped unless it is a base phrase, and of equal intervals the rule of the
higher priority stays. Everything is one projection of built-in functions over a literal table of
rules: a row is never shuffled, and a document's matches are all that is held.

Sentences of license texts and notices are written by hand (NOTICES); names of families, their versions
and the ways to write them are multiplied.

Defined results for unusual input: a null or empty text has no words and no labels, score 0;
repeated rows are scanned alike; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import ascii_lower, bound

#: Between words, once A-Z are in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    """Words as a pattern (a blank between words), what it means, and how much it is trusted. One of
    the keywords (split at |) is in whatever the pattern matches."""

    label: str
    pattern: str
    keyword: str
    priority: int
    weight: float
    base: bool = False

    def keywords(self) -> list[str]:
        return self.keyword.split("|")

    def regex(self) -> str:
        spaced = self.pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")
        return f" (?:{spaced}) "


#: The contract's base phrases.
BASE = (
    Rule("cc-by", "cc by", "cc", 0, 0.6, True),
    Rule("gpl", "general public license", "general", 0, 0.7, True),
    Rule("reserved", "all rights reserved", "reserved", 0, 0.5, True),
)

#: label, name in words, keyword, versions (first number as words of digits).
FAMILIES = (
    ("gpl", "gnu general public licen[cs]e", "gnu", ("1", "2", "3")),
    ("lgpl", "gnu (?:lesser|library) general public licen[cs]e", "gnu", ("2", "2 1", "3")),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", "affero", ("1", "3")),
    ("gfdl", "gnu free documentation licen[cs]e", "gnu", ("1 1", "1 2", "1 3")),
    ("apache", "apache (?:software )?licen[cs]e", "apache", ("1 0", "1 1", "2", "2 0")),
    ("mpl", "mozilla public licen[cs]e", "mozilla", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public licen[cs]e", "eclipse", ("1 0", "2 0")),
    ("cddl", "common development and distribution licen[cs]e", "development", ("1 0", "1 1")),
    ("eupl", "european union public licen[cs]e", "european", ("1 0", "1 1", "1 2")),
    ("osl", "open software licen[cs]e", "open", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free licen[cs]e", "academic", ("1 1", "2 0", "2 1", "3 0")),
    ("artistic", "artistic licen[cs]e", "artistic", ("1 0", "2 0")),
    ("ofl", "sil open font licen[cs]e", "font", ("1 0", "1 1")),
    ("bsl", "boost software licen[cs]e", "boost", ("1 0",)),
    ("ms-pl", "microsoft public licen[cs]e", "microsoft", ()),
    ("isc", "isc licen[cs]e", "isc", ()),
    ("mit", "mit licen[cs]e", "mit", ()),
    ("zlib", "zlib licen[cs]e", "zlib", ()),
    ("unlicense", "(?:the )?unlicen[cs]e", "unlicense|unlicence", ()),
    ("odbl", "open (?:data commons open )?database licen[cs]e", "database", ("1 0",)),
    ("python", "python software foundation licen[cs]e", "python", ("2",)),
)
CC_FAMILIES = (
    ("by", "attribution"),
    ("by-sa", "attribution share ?alike"),
    ("by-nd", "attribution no ?deriv(?:ative)?s?"),
    ("by-nc", "attribution non ?commercial"),
    ("by-nc-sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Short identifiers without a version of their own: the words, and the label.
SHORT = (
    ("mit", "mit"), ("mit 0", "mit-0"), ("isc", "isc"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("0bsd", "0bsd"),
    ("bsd 2 clause", "bsd-2-clause"), ("bsd 3 clause", "bsd-3-clause"), ("bsd 4 clause", "bsd-4-clause"), ("bsd 3 clause clear", "bsd-3-clause-clear"),
    ("cc0 1 0", "cc0"), ("pddl 1 0", "pddl"), ("blueoak 1 0 0", "blueoak"), ("ncsa", "ncsa"), ("postgresql", "postgresql"), ("x11", "x11"), ("curl", "curl"),
    ("openssl", "openssl"), ("beerware", "beerware"), ("vim", "vim"), ("ms pl", "ms-pl"), ("ms rl", "ms-rl"), ("libpng 2 0", "libpng"), ("python 2 0", "python-2"),
    ("busl 1 1", "busl"), ("sspl 1 0", "sspl"), ("elastic 2 0", "elastic"), ("mulanpsl 2 0", "mulanpsl"), ("upl 1 0", "upl"),
)
#: Sentences and phrases of license texts, notices and headers: label, words, keyword, priority, weight.
NOTICES = tuple(Rule(*x) for x in (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission", 60, 0.95),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission", 60, 0.95),
    ("mit", "(?:released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit", "mit", 45, 0.85),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "liable", 55, 0.8),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission", 60, 0.95),
    ("isc", "the software is provided as is and the author disclaims all warranties", "disclaims", 55, 0.85),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution", 60, 0.95),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions", 60, 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions", 60, 0.9),
    ("bsd-3-clause", "neither the name of .{1,200}? nor the names of its contributors may be used to endorse or promote products", "endorse", 65, 0.95),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising", 65, 0.95),
    ("bsd", "(?:2|3|4|two|three|four) clause bsd(?: licen[cs]e)?", "bsd", 50, 0.8),
    ("bsd", "bsd (?:2|3|4) clause(?: licen[cs]e)?", "bsd", 50, 0.85),
    ("bsd", "(?:new |modified |simplified |revised |original )?bsd (?:style )?licen[cs]e", "bsd", 50, 0.8),
    ("apache-2", "licensed under the apache license version 2 0 the license", "apache", 65, 1.0),
    ("apache-2", "you may not use this file except in compliance with the license", "compliance", 55, 0.85),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable", 60, 0.9),
    ("apache-2", "www apache org licenses license 2 0", "apache", 65, 1.0),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute", 60, 0.95),
    ("gpl", "you should have received a copy of the gnu general public license along with this", "gnu", 60, 0.95),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", "merchantability", 60, 0.9),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with this", "gnu", 62, 0.95),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute", 62, 0.95),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this", "affero", 62, 0.95),
    ("gpl-3", "www gnu org licenses gpl 3 0", "gnu", 65, 1.0),
    ("gpl-2", "www gnu org licenses (?:old licenses )?gpl 2 0", "gnu", 65, 1.0),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "document", 62, 0.95),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla", 65, 1.0),
    ("mpl-2", "if a copy of the mpl was not distributed with this file", "mpl", 60, 0.95),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "mozilla", 65, 1.0),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse", 62, 0.95),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "development", 62, 0.95),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "warranty", 60, 0.9),
    ("zlib", "the origin of this software must not be misrepresented", "misrepresented", 60, 0.9),
    ("zlib", "altered source versions must be plainly marked as such", "altered", 60, 0.9),
    ("bsl-1", "distributed under the boost software license version 1 0", "boost", 65, 1.0),
    ("bsl-1", "www boost org license 1 0 txt", "boost", 65, 1.0),
    ("artistic-2", "this copyright notice does not grant you any rights other than those stated in the artistic license", "artistic", 62, 0.8),
    ("artistic", "(?:same terms as|under the same terms as) perl itself", "perl", 55, 0.85),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "font", 65, 1.0),
    ("ofl", "scripts sil org ofl", "ofl", 60, 0.95),
    ("eupl", "licensed under the eupl", "eupl", 60, 0.9),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 65, 1.0),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "compile", 60, 0.95),
    ("public-domain", "(?:released|placed|dedicated) (?:in )?(?:in)?to the public domain", "public", 50, 0.8),
    ("public-domain", "(?:is|are|was) in the public domain", "public", 45, 0.7),
    ("public-domain", "public domain dedication", "public", 50, 0.8),
    ("public-domain", "waive[sd]? all copyright and related (?:or|and) neighboring rights", "neighboring", 60, 0.9),
    ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0", 50, 0.9),
    ("cc0", "creative commons zero", "creative", 50, 0.9),
    ("cc0", "creativecommons org publicdomain zero 1 0", "creativecommons", 65, 1.0),
    ("public-domain", "creativecommons org publicdomain mark 1 0", "creativecommons", 65, 1.0),
    ("cc", "(?:under|with|by) a creative commons licen[cs]e", "creative", 40, 0.7),
    ("cc", "some rights reserved", "reserved", 30, 0.5),
    ("cc", "to view a copy of this licen[cs]e visit", "view", 40, 0.6),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "public", 60, 0.95),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer", "beer", 60, 0.95),
    ("openssl", "this product includes software developed by the openssl project", "openssl", 60, 0.95),
    ("python", "psf is making python available to licensee on an as is basis", "psf", 62, 0.95),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee", "permission", 61, 0.95),
    ("ncsa", "university of illinois(?: ncsa)? open source licen[cs]e", "illinois", 60, 0.95),
    ("sspl", "server side public licen[cs]e", "server", 50, 0.9),
    ("busl", "business source licen[cs]e(?: 1 1)?", "business", 50, 0.9),
    ("elastic", "elastic licen[cs]e(?: 2 0)?", "elastic", 50, 0.9),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", "verbatim", 62, 0.9),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim", 62, 0.9),
    ("proprietary", "(?:may not|must not) be (?:reproduced|copied|distributed) without (?:prior )?(?:written )?permission", "permission", 50, 0.7),
    ("proprietary", "no part of this (?:publication|book|document|work) may be reproduced", "reproduced", 50, 0.8),
    ("proprietary", "proprietary and confidential", "proprietary", 50, 0.7),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution|use) (?:of this file )?(?:via any medium )?is (?:strictly )?prohibited", "prohibited", 50, 0.8),
    ("proprietary", "for (?:personal|internal) use only", "only", 30, 0.4),
    ("non-commercial", "for non ?commercial (?:use|purposes)(?: only)?", "noncommercial|commercial", 40, 0.6),
    ("reprint", "(?:reprinted|reproduced|used) with (?:kind )?permission(?: of| from)?", "permission", 40, 0.6),
    ("trademark", "(?:is a|are) (?:registered )?trademarks? (?:or registered trademarks )?of", "trademark|trademarks", 30, 0.3),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", "copyright", 20, 0.4),
    ("copyright", "copyright (?:by|holder|holders|notice|owner)", "copyright", 10, 0.3),
    ("reserved", "copyright (?:c )?(?:(?:19|20)[0-9]{2} )?[^ ]+ all rights reserved", "copyright", 40, 0.6),
    ("reserved", "all rights not expressly granted (?:herein )?are reserved", "reserved", 45, 0.6),
    ("licensed", "(?:is |are )?licen[cs]ed under(?: the)?(?: terms of)?", "licensed|licenced", 5, 0.2),
    ("licensed", "see (?:the )?(?:file )?licen[cs]e (?:file |txt |md )?for (?:more )?(?:details|information|terms)", "license|licence", 10, 0.3),
    ("licensed", "licen[cs]e agreement", "license|licence", 5, 0.2),
    ("licensed", "terms and conditions of (?:this|the) licen[cs]e", "license|licence", 8, 0.25),
))


def _families() -> list[Rule]:
    found = []
    for label, name, keyword, versions in FAMILIES:
        found.append(Rule(label, f"(?:the )?{name}", keyword, 30, 0.8))
        found.append(Rule(label, f"(?:is )?(?:released|distributed|available|licen[cs]ed) under (?:the )?(?:terms of the )?{name}", keyword, 40, 0.9))
        for version in versions:
            short = version.removesuffix(" 0")
            number = f"(?:version |v )?{version}" if short == version else f"(?:version |v )?{short}(?: 0)?"
            tag = f"{label}-{version.replace(' ', '.')}"
            found.append(Rule(tag, f"(?:the )?{name} {number}(?: only)?", keyword, 50, 0.95))
            found.append(Rule(f"{tag}-or-later", f"(?:the )?{name} (?:either )?{number} (?:of the licen[cs]e )?or (?:at your option )?(?:any )?later(?: version)?", keyword, 55, 0.95))
            if label.isalpha():
                later = "(?: or| or any)? later"
                whole = f"{short}(?: 0)?" if " " not in short else short
                found.append(Rule(tag, f"{label} (?:v|version )?{whole}(?: only)?", label, 45, 0.85))
                found.append(Rule(f"{tag}-or-later", f"{label} (?:v|version )?{whole}{later}", label, 50, 0.9))
                major, rest = short.split(" ")[0], short[len(short.split(" ")[0]) :]
                joined = f"{label}v{major}|{label}{major}"
                found.append(Rule(tag, f"{label}v?{major}{rest or '(?: 0)?'}(?: only)?", joined, 45, 0.85))
                found.append(Rule(f"{tag}-or-later", f"{label}v?{major}{rest or '(?: 0)?'}{later}", joined, 50, 0.9))
                found.append(Rule(tag, f"spdx licen[cs]e identifier {label} {whole}(?: only)?", "spdx", 70, 1.0))
                found.append(Rule(f"{tag}-or-later", f"spdx licen[cs]e identifier {label} {whole} or later", "spdx", 72, 1.0))
    return found


def _short_names() -> list[Rule]:
    return [Rule(label, f"spdx licen[cs]e identifier {words}", "spdx", 71 + words.count(" "), 1.0) for words, label in SHORT]


def _creative_commons() -> list[Rule]:
    found = []
    for code, name in CC_FAMILIES:
        label, words = f"cc-{code}", code.replace("-", " ")
        if code != "by":
            found.append(Rule(label, f"cc {words}", "cc", 30, 0.8))
        found.append(Rule(label, f"creative commons {name}(?: licen[cs]e)?", "creative", 35, 0.85))
        for version in CC_VERSIONS:
            tag = f"{label}-{version.replace(' ', '.')}"
            found.append(Rule(tag, f"cc {words} {version}(?: international| unported)?", "cc", 50, 0.95))
            found.append(Rule(tag, f"creative commons {name} {version}(?: international| unported)?(?: licen[cs]e)?", "creative", 55, 0.95))
            found.append(Rule(tag, f"creativecommons org licenses {words} {version}", "creativecommons", 60, 1.0))
            found.append(Rule(tag, f"spdx licen[cs]e identifier cc {words} {version}", "spdx", 70, 1.0))
    return found


RULES: tuple[Rule, ...] = (*BASE, *_families(), *_creative_commons(), *_short_names(), *NOTICES)
KEYWORDS = tuple(sorted({k for r in RULES for k in r.keywords()}))
_MATCH = "array<struct<start:int,stop:int,priority:int,rule:int,label:string,weight:double,base:boolean>>"


def _table(rules: tuple[Rule, ...]) -> Column:
    """The rules as one literal array."""
    return F.array(
        *(
            F.struct(F.lit(r.regex()).alias("regex"), F.array(*map(F.lit, r.keywords())).alias("keywords"), F.lit(r.priority).alias("priority"), F.lit(k).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight"), F.lit(r.base).alias("base"))
            for k, r in enumerate(rules)
        )
    )


def _matches(normal: Column, rule: Column) -> Column:
    """The rule's matches as intervals of words [start, stop).

    Marks are put before and after each match; in ' a  b  c ' split at blanks, the place between
    two words, 2 * k, holds the marks of what begins at word k or ends before it.
    """
    marked = F.split(F.regexp_replace(normal, rule["regex"], F.lit("\x01$0\x02")), " ")

    def places(slots: Column, mark: str) -> Column:
        return F.filter(F.transform(slots, lambda x, i: F.when(x.contains(mark), (i / 2).cast("int"))), lambda i: i.isNotNull())

    def intervals(slots: Column) -> Column:
        pairs = F.arrays_zip(places(slots, "\x01").alias("start"), places(slots, "\x02").alias("stop"))
        return F.transform(
            pairs,
            lambda p: F.struct(
                p["start"].alias("start"), p["stop"].alias("stop"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base")
            ),
        )

    return F.when(F.rlike(normal, rule["regex"]), bound(marked, intervals)).otherwise(F.array().cast(_MATCH))


def _unsuppressed(matches: Column) -> Column:
    """Those that lie in no other's interval: in order of start, then the longest, the highest
    priority and the first rule, a match that ends no later than one before it is inside it."""
    ordered = F.array_sort(
        F.transform(
            matches,
            lambda m: F.struct(m["start"].alias("start"), (-m["stop"]).alias("stop"), (-m["priority"]).alias("priority"), m["rule"].alias("rule"), m["label"].alias("label"), m["weight"].alias("weight"), m["base"].alias("base")),
        )
    )
    empty = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<label:string,weight:double>>").alias("kept"))
    return F.aggregate(
        ordered,
        empty,
        lambda acc, m: F.struct(
            F.greatest(acc["end"], -m["stop"]).alias("end"),
            F.when(-m["stop"] > acc["end"], F.array_union(acc["kept"], F.array(F.struct(m["label"].alias("label"), m["weight"].alias("weight"))))).otherwise(acc["kept"]).alias("kept"),
        ),
        lambda acc: acc["kept"],
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    keywords = F.array(*map(F.lit, sorted({k for r in rules for k in r.keywords()})))

    def of(words: Column) -> Column:
        return bound(F.array_intersect(words, keywords), lambda hit: F.struct(F.size(words).cast("long").alias("n_words"), matched(words, hit).alias("matches")))

    def matched(words: Column, hit: Column) -> Column:
        normal = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
        mine = F.filter(_table(rules), lambda r: F.arrays_overlap(hit, r["keywords"]))
        found = bound(normal, lambda n: F.flatten(F.transform(mine, lambda r: _matches(n, r))))
        return F.when(F.size(hit) > 0, found).otherwise(F.array().cast(_MATCH))

    words = F.array_remove(F.split(ascii_lower(F.col("text")), GAP), "")
    read = docs.select(F.col("doc_id"), bound(words, of).alias("s"))

    def summary(matches: Column) -> Column:
        base = F.filter(matches, lambda m: m["base"])
        return bound(
            base,
            lambda b: bound(
                _unsuppressed(matches),
                lambda kept: F.struct(
                    F.size(b).cast("long").alias("n_base"),
                    F.array_min(F.transform(b, lambda m: m["start"])).cast("long").alias("first_word"),
                    F.array_max(F.transform(b, lambda m: m["start"])).cast("long").alias("last_word"),
                    F.array_join(F.sort_array(F.array_distinct(F.transform(b, lambda m: m["label"]))), ",").alias("base_labels"),
                    F.array_join(F.sort_array(F.array_distinct(F.concat(F.transform(b, lambda m: m["label"]), F.transform(kept, lambda k: k["label"])))), ",").alias("labels"),
                    F.coalesce(F.array_max(F.concat(F.transform(b, lambda m: m["weight"]), F.transform(kept, lambda k: k["weight"]))), F.lit(0.0)).alias("score"),
                ),
            ),
        )

    return read.select("doc_id", "s.n_words", bound(F.col("s.matches"), summary).alias("r")).select("doc_id", "n_words", "r.*")


def op2_license_scan(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scan(docs)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


OP2_SQL = f"""
WITH rules(rule, regex, keywords, priority, label, weight, base) AS (VALUES {", ".join(f"({k}, {_text(r.regex())}, [{", ".join(f"'{x}'" for x in r.keywords())}], {r.priority}, '{r.label}', {r.weight}::DOUBLE, {r.base})" for k, r in enumerate(RULES))}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{GAP}'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT rid, w, ' ' || array_to_string(w, '  ') || ' ' AS normal FROM d WHERE list_has_any(w, [{", ".join(f"'{k}'" for k in KEYWORDS)}])),
m AS (SELECT rid, rule, priority, label, weight, base, string_split(regexp_replace(normal, regex, chr(1) || '\\0' || chr(2), 'g'), ' ') AS slots
    FROM n JOIN rules ON list_has_any(w, keywords) WHERE regexp_matches(normal, regex)),
p AS (SELECT rid, rule, priority, label, weight, base, unnest(list_filter(list_transform(slots, lambda x, i: CASE WHEN contains(x, chr(1)) THEN (i - 1) // 2 END), lambda i: i IS NOT NULL)) AS start,
    unnest(list_filter(list_transform(slots, lambda x, i: CASE WHEN contains(x, chr(2)) THEN (i - 1) // 2 END), lambda i: i IS NOT NULL)) AS stop FROM m),
s AS (SELECT *, stop <= coalesce(max(stop) OVER (PARTITION BY rid ORDER BY start, stop DESC, priority DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS inside FROM p),
g AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
    list_sort(list(DISTINCT label) FILTER (WHERE base)) AS bl, list_sort(list(DISTINCT label) FILTER (WHERE base OR NOT inside)) AS al,
    max(weight) FILTER (WHERE base OR NOT inside) AS score FROM s GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(al, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (rid)"""
