"""Licence scan by sentence rules (DataFrame functions only).

A text is cut into sentences (after ``. ; : ! ?`` and at blank lines), which
are normalised to lower-case ASCII words. Known licence sentences map to
identifiers; the expression of an SPDX tag is a sentence that gives one for
each of its licences and exceptions. The identifiers of a text, in order, are matched against licence
rules, sequences of identifiers, the more specific rules first; what a rule
has taken is not matched again. Everything happens within the row: no shuffle.

Defined results: NULL, empty and unlicensed texts have no identifiers; known
sentences that no rule takes (a denial among them) are reported as
unresolved; names in tags that are not in the table are passed over;
repeated rows give repeated results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: a licence name in an expression, with the brackets around it
NAME = r"(?:\([ \t]*)*[A-Za-z0-9][A-Za-z0-9.+-]*(?:[ \t]*\))*"
#: a tag with its expression; operators are written in capitals
TAG = rf"SPDX-License-Identifier:[ \t]*({NAME}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{NAME})*)"
TAGGED = "spdx license identifier "
#: "2.0+" is "2.0-or-later"
PLUS = r"([0-9])\+([ \t\r\n)]|$)"
#: a sentence without one of these words is no licence sentence
CUE = (
    "licen|copyright|permission|redistribut|warrant|as is|public domain|unencumbered|endorse|liable|spdx|gnu |mozilla"
    "|creative commons|rights reserved|free software|applicable law|advertising materials|bsd|gpl|mpl |cc0|cc by|later version"
)

# Patterns of normalised licence sentences and their identifiers; the first that matches counts.
SENTENCES: list[tuple[str, str]] = [
    ("denied", "(^| )not (licensed |released |distributed |available |covered |published )?(under|by) (the |an? )?([a-z0-9]+ ){0,6}licen[cs]e"),
    ("apache2-except", "you may not use this (file|work) except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at"),
    ("apache2-law", "unless required by applicable law or agreed to in writing"),
    ("apache2-see", "see the license for the specific language governing permissions"),
    ("apache2-ref", "apache license,? version 2 0|apache 2 0 license"),
    ("apache-ref", "apache license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("mit-asis", "the software is provided as is without warranty of any kind"),
    ("mit-liable", "in no event shall the authors or copyright holders be liable"),
    ("mit-ref", "(^| )mit license|license (is )?mit( |$)"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose"),
    ("isc-asis", "the software is provided as is and the author disclaims all warranties"),
    ("isc-ref", "(^| )isc license"),
    ("bsd-redist", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software"),
    ("bsd-endorse", "neither the names? of .* may be used to endorse or promote products"),
    ("bsd-asis", "this software is provided by .* as is and any express or implied warranties"),
    ("bsd-liable", "in no event shall .* be liable for any direct indirect incidental special"),
    ("bsd3-ref", "bsd 3 clause|3 clause bsd|new bsd license"),
    ("bsd2-ref", "bsd 2 clause|2 clause bsd|simplified bsd license"),
    ("bsd-ref", "(^| )bsd license"),
    ("agpl-see", "see the gnu affero general public license for more details"),
    ("lgpl-see", "see the gnu (lesser|library) general public license for more details"),
    ("gpl-see", "see the gnu general public license for more details"),
    ("agpl3-later", "gnu affero general public license.*version 3.*any later version"),
    ("lgpl21-later", "gnu lesser general public license.*version 2 1.*any later version"),
    ("lgpl3-later", "gnu lesser general public license.*version 3.*any later version"),
    ("agpl3-terms", "gnu affero general public license.*version 3"),
    ("lgpl21-terms", "gnu lesser general public license.*version 2 1"),
    ("lgpl3-terms", "gnu lesser general public license.*version 3"),
    ("gpl3-later", "gnu general public license.*version 3.*any later version"),
    ("gpl2-later", "gnu general public license.*version 2.*any later version"),
    ("gpl3-terms", "gnu general public license.*version 3|(^| )gplv3"),
    ("gpl2-terms", "gnu general public license.*version 2|(^| )gplv2"),
    ("gnu-warranty", "without even the implied warranty of merchantability or fitness"),
    ("gnu-copy", "you should have received a copy of the gnu .*general public license"),
    ("gnu-free", "this (program|library) is free software"),
    ("gpl-ref", "gnu general public license"),
    ("lgpl-ref", "gnu (lesser|library) general public license"),
    ("agpl-ref", "gnu affero general public license"),
    ("ver21-later", "(^| )version 2 1( of the license)? or( at your option)? any later version"),
    ("ver2-later", "(^| )version 2( 0)?( of the license)? or( at your option)? any later version"),
    ("ver3-later", "(^| )version 3( 0)?( of the license)? or( at your option)? any later version"),
    ("ver21-only", "^version 2 1 of the license"),
    ("ver2-only", "^version 2 of the license"),
    ("ver3-only", "^version 3 of the license"),
    ("mpl2-terms", "subject to the terms of the mozilla public license v(ersion)? ?2 0|mozilla public license version 2 0"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file"),
    ("epl2-ref", "eclipse public license (v|version )2 0"),
    ("cc0-ref", "creative commons zero|cc0 1 0"),
    ("ccbysa4-ref", "creative commons attribution share ?alike 4 0|cc by sa 4 0"),
    ("ccby4-ref", "creative commons attribution 4 0|cc by 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("boost-ref", "boost software license version 1 0"),
    ("public-domain", "(is|are|placed|released) (hereby )?(in|into) the public domain"),
    ("rights", "all rights reserved"),
    ("copyright", "(^| )copyright( c)? (19|20)[0-9][0-9]|(^| )copyright c "),
]
# Names of licences and exceptions in SPDX tags.
SPDX = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause
    BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CPL-1.0
    ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only
    GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only
    LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL
    PostgreSQL PSF-2.0 Unlicense UPL-1.0 WTFPL X11 Zlib ZPL-2.1""".split()
EXCEPTIONS = {
    "Classpath-exception-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "Linux-syscall-note": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-1.0-or-later", "LGPL-2.1-or-later"],
    "GCC-exception-3.1": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LLVM-exception": ["Apache-2.0"],
    "Font-exception-2.0": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"],
}


def tag_names() -> dict[str, str]:
    """Identifiers of tags by the normalised name; "or later" is one word there, so that it can't be an operator."""
    names = {n: f"spdx:{n}" for n in SPDX} | {n: f"with:{n}" for n in EXCEPTIONS}
    later = {n.replace("-or-later", " orlater"): i for n, i in names.items()}
    return {n.lower().replace(".", " ").replace("-", " "): i for n, i in later.items()}


# GNU notices: licence, name, and the sentence or the two clauses (cut at a semicolon) that give the version.
GNU: list[tuple[str, str, list[str]]] = [
    ("AGPL-3.0-or-later", "agpl", ["agpl3-later"]), ("AGPL-3.0-or-later", "agpl", ["agpl-ref", "ver3-later"]),
    ("LGPL-2.1-or-later", "lgpl", ["lgpl21-later"]), ("LGPL-2.1-or-later", "lgpl", ["lgpl-ref", "ver21-later"]),
    ("LGPL-2.0-or-later", "lgpl", ["lgpl-ref", "ver2-later"]),
    ("LGPL-3.0-or-later", "lgpl", ["lgpl3-later"]), ("LGPL-3.0-or-later", "lgpl", ["lgpl-ref", "ver3-later"]),
    ("GPL-3.0-or-later", "gpl", ["gpl3-later"]), ("GPL-3.0-or-later", "gpl", ["gpl-ref", "ver3-later"]),
    ("GPL-2.0-or-later", "gpl", ["gpl2-later"]), ("GPL-2.0-or-later", "gpl", ["gpl-ref", "ver2-later"]),
    ("AGPL-3.0", "agpl", ["agpl3-terms"]), ("AGPL-3.0", "agpl", ["agpl-ref", "ver3-only"]),
    ("LGPL-2.1", "lgpl", ["lgpl21-terms"]), ("LGPL-2.1", "lgpl", ["lgpl-ref", "ver21-only"]),
    ("LGPL-3.0", "lgpl", ["lgpl3-terms"]), ("LGPL-3.0", "lgpl", ["lgpl-ref", "ver3-only"]),
    ("GPL-3.0", "gpl", ["gpl3-terms"]), ("GPL-3.0", "gpl", ["gpl-ref", "ver3-only"]),
    ("GPL-2.0", "gpl", ["gpl2-terms"]), ("GPL-2.0", "gpl", ["gpl-ref", "ver2-only"]),
]


def gnu_rules() -> list[tuple[str, list[str]]]:
    """Each notice with and without the sentences around it, the longer first."""
    out = []
    for name, short, version in GNU:
        for tail in (["gnu-warranty", f"{short}-see", "gnu-copy"], ["gnu-warranty", f"{short}-see"], ["gnu-warranty", "gnu-copy"], []):
            out.append((name, ["gnu-free", *version, *tail]))
    return out + [(name, version) for name, _, version in GNU]


# Licence rules in order; each is a sequence of identifiers.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache2-ref", "apache2-except", "apache2-copy", "apache2-law", "apache2-see"]),
    ("Apache-2.0", ["apache2-ref", "apache2-except", "apache2-copy", "apache2-law"]),
    ("Apache-2.0", ["apache2-ref", "apache2-except"]),
    ("MIT", ["mit-ref", "copyright", "mit-grant", "mit-notice", "mit-asis", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant", "isc-asis"]),
    ("BSD-4-Clause", ["bsd-redist", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-asis", "bsd-liable"]),
    ("BSD-3-Clause", ["bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis", "bsd-liable"]),
    ("BSD-3-Clause", ["bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redist", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liable"]),
    ("BSD-2-Clause", ["bsd-redist", "bsd-source", "bsd-binary"]),
    *gnu_rules(),
    ("MPL-2.0", ["mpl2-terms", "mpl2-copy"]),
    *((f"{n} WITH {e}", [f"spdx:{n}", f"with:{e}"]) for e, names in EXCEPTIONS.items() for n in names),
    ("Apache-2.0", ["apache2-ref"]), ("Apache", ["apache-ref"]), ("MIT", ["mit-ref"]), ("ISC", ["isc-ref"]),
    ("BSD-3-Clause", ["bsd3-ref"]), ("BSD-2-Clause", ["bsd2-ref"]), ("BSD", ["bsd-ref"]), ("AGPL", ["agpl-ref"]), ("AGPL", ["agpl-see"]),
    ("LGPL", ["lgpl-ref"]), ("LGPL", ["lgpl-see"]), ("GPL", ["gpl-ref"]), ("GPL", ["gpl-see"]),
    ("MPL-2.0", ["mpl2-terms"]), ("EPL-2.0", ["epl2-ref"]), ("CC0-1.0", ["cc0-ref"]), ("CC-BY-SA-4.0", ["ccbysa4-ref"]),
    ("CC-BY-4.0", ["ccby4-ref"]), ("Unlicense", ["unlicense"]), ("BSL-1.0", ["boost-ref"]), ("Public-Domain", ["public-domain"]),
]


def sentence_id(sentence: Column) -> Column:
    """The identifier of a normalised sentence, NULL if it is none."""
    first, *rest = SENTENCES
    pick = F.when(sentence.rlike(first[1]), first[0])
    return reduce(lambda c, s: c.when(sentence.rlike(s[1]), s[0]), rest, pick)


def tag_ids(sentence: Column) -> Column:
    """The identifiers of a tag's licences and exceptions, NULL for unknown names."""
    terms = F.split(F.replace(sentence, F.lit(" or later"), F.lit(" orlater")), " (?:or|and|with) ")
    names = F.create_map(*(F.lit(x) for pair in tag_names().items() for x in pair))
    return F.transform(terms, lambda t: F.try_element_at(names, F.trim(t)))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the licence sentences of ``text``, in order."""
    plus = F.regexp_replace(F.coalesce(text, F.lit("")), PLUS, "$1-or-later$2")
    tagged = F.regexp_replace(plus, TAG, f"\n\n{TAGGED}$1\n\n")
    cut = F.regexp_replace(tagged, r"([.;:!?])[ \t\r\n]+|\n[ \t\r]*\n", "$1\n\n")
    words = F.regexp_replace(F.translate(cut, UPPER + "|", LOWER + " "), r"\n\n", "|")  # "|" in a text cuts nothing
    plain = F.split(F.regexp_replace(words, r"[^a-z0-9|]+", " "), r"\|")
    cued = F.transform(F.filter(plain, lambda s: s.rlike(CUE)), lambda s: F.trim(s))
    tag = F.lit(TAGGED)
    ids = F.transform(cued, lambda s: F.when(F.startswith(s, tag), tag_ids(F.substring(s, len(TAGGED) + 1, 1 << 30))).otherwise(F.array(sentence_id(s))))
    return F.filter(F.flatten(ids), lambda i: i.isNotNull())


def resolved(ids: Column) -> Column:
    """The identifiers in order, ``<...>`` each, with what rules took replaced by ``[licence]``."""
    start = F.concat_ws("", F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))))
    steps = [("".join(f"<{i}>" for i in seq), f"[{name}]") for name, seq in RULES]
    taken = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, start)
    return F.regexp_replace(taken, "<spdx:([^>]+)>", "[$1]")  # the last rule: any other name of a tag is that licence


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licenses, unresolved`` (lists joined by commas) per row of ``docs(doc_id, text)``."""
    found = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    marked = found.withColumn("marked", F.when(F.size("ids") > 0, resolved(F.col("ids"))).otherwise(""))
    names = F.regexp_extract_all("marked", F.lit(r"\[([^\]]+)\]"), F.lit(1))
    rest = F.regexp_extract_all("marked", F.lit(r"<([^>]+)>"), F.lit(1))
    return marked.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.concat_ws(",", "ids").alias("sentence_ids"),
        F.concat_ws(",", F.array_sort(F.array_distinct(names))).alias("licenses"),
        F.concat_ws(",", rest).alias("unresolved"),
    )


def oracle() -> str:
    """The same in DuckDB, from the same tables of sentences, names and rules."""
    case = " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{i}'" for i, p in SENTENCES)
    names = " ".join(f"WHEN '{n}' THEN '{i}'" for n, i in tag_names().items())
    marked = "array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '')"
    for name, seq in RULES:
        marked = f"replace({marked}, '{''.join(f'<{i}>' for i in seq)}', '[{name}]')"
    marked = f"regexp_replace({marked}, '<spdx:([^>]+)>', '[\\1]', 'g')"
    return rf"""
WITH tagged AS (
  SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{PLUS}', '\1-or-later\2', 'g'), '{TAG}',
    chr(10) || chr(10) || '{TAGGED}\1' || chr(10) || chr(10), 'g') AS t FROM documents
), cut AS (
  SELECT doc_id, regexp_replace(t, '([.;:!?])[ \t\r\n]+|\n[ \t\r]*\n', '\1' || chr(10) || chr(10), 'g') AS t FROM tagged
), plain AS (
  SELECT doc_id, string_split(regexp_replace(replace(translate(t, '{UPPER}|', '{LOWER} '), chr(10) || chr(10), '|'), '[^a-z0-9|]+', ' ', 'g'), '|') AS ss
  FROM cut
), known AS (
  SELECT doc_id, list_filter(flatten(list_transform(list_transform(list_filter(ss, lambda s: regexp_matches(s, '{CUE}')), lambda r: trim(r)), lambda s:
    CASE WHEN starts_with(s, '{TAGGED}') THEN list_transform(
      regexp_split_to_array(replace(substr(s, {len(TAGGED) + 1}), ' or later', ' orlater'), ' (?:or|and|with) '), lambda n: CASE trim(n) {names} END)
    ELSE [CASE {case} END] END)), lambda i: i IS NOT NULL) AS ids
  FROM plain
), marked AS (
  SELECT doc_id, ids, {marked} AS m FROM known
)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_sort(list_distinct(regexp_extract_all(m, '\[([^\]]+)\]', 1))), ',') AS licenses,
  array_to_string(regexp_extract_all(m, '<([^>]+)>', 1), ',') AS unresolved
FROM marked"""
