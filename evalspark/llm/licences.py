"""Operator 7 [native]: licence scans by sentence rules.

1. *Sentences.*  A text is cut at sentence ends and blank lines into sentences of one or more lines,
   without comment marks, and normalised (lower case, runs of other characters than letters, digits,
   dots and plus signs are one space).
2. *Identifiers.*  A normalised sentence that is known becomes its identifier.  Of other sentences each
   run of whole lines that is known (headings and statements without a full stop), the first and
   longest ones; runs of unknown lines and sentences are one ``?``.  A known notice whose own words
   hold sentence ends ('License, v. 2.0', 'SPDX-License-Identifier: MIT') has an identifier for each
   of its pieces; their sequence becomes the notice's, pieces alone are unknown.
3. *Rules.*  Ordered licence rules, each a sequence of identifiers, are matched against the sequence;
   what a rule has matched is taken out before the next.

``n_sentences`` counts the pieces between sentence ends and line ends.  Texts that hold no word that
every known sentence needs skip step 2.  Sentences must be known word by word: a notice that names its
owner inside a sentence, or an expression of several SPDX names, is not found.

Defined results: NULL and empty texts have no sentences and no licences; a licence found several
times is named once, in the order of the rules; rows with equal ids count each; texts of any
length are read whole; other columns play no part."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import table

# Normalised sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction including "
                 "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                 "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                 "the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or "
                  "substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited "
             "to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                 "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software "
                 "including all implied warranties of merchantability and fitness",
    "apache-2": "licensed under the apache license version 2.0",
    "apache-2-the": "licensed under the apache license version 2.0 the license",
    "apache-obey": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl-2-work": "this work is licensed under the gnu general public license version 2",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "lgpl-3-work": "this work is licensed under the gnu lesser general public license version 3",
    "agpl-3-work": "this work is licensed under the gnu affero general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                "general public license as published by the free software foundation either version 3 of the license "
                "or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even "
                "the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided "
                 "that the following conditions are met",
    "bsd-licensed": "licensed under the bsd 3 clause license",
    "cc-by": "licensed under cc by 4.0",
    "cc-by-sa": "licensed under cc by sa 4.0",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by-nc-nd": "licensed under cc by nc nd 4.0",
    "cc0": "released under cc0 1.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights": "all rights reserved",
}

# Public notices in their own words, by identifier, which are cut as texts are.
NOTICES = {
    "gpl-hope": ["This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
                 "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "apache-head": ["Apache License Version 2.0, January 2004"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                   "following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
                   "following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                  "products derived from this software without specific prior written permission."],
    "bsd-2-licensed": ["Licensed under the BSD 2-Clause License."],
    "bsl-1": ["Distributed under the Boost Software License, Version 1.0."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
                   "to alter it and redistribute it freely, subject to the following restrictions:"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                   "hereby granted."],
}
SUBJECTS = ("program", "library", "file", "software")
_LATER = ("This {what} is free software{a} you can redistribute it and/or modify it under the terms of the {name} as published "
          "by the Free Software Foundation{b} either version {v} of the License, or (at your option) any later version.")
_ONLY = ["This {what} is free software{a} you can redistribute it and/or modify it under the terms of the {name} as published "
         "by the Free Software Foundation{b} version {v} of the License.",
         "This {what} is free software{a} you can redistribute it and/or modify it under the terms of the {name} version {v} as "
         "published by the Free Software Foundation."]
# The GNU licences' names and versions, the Creative Commons kinds, other SPDX names.
GNU = {"GPL": ("GNU General Public License", ("2", "3")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3")),
       "AGPL": ("GNU Affero General Public License", ("3",))}
CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
            "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
            "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
OTHER_SPDX = ("MIT", "ISC", "Apache-2.0", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0")

# Licences and the identifier sequences that mean them, longer ones first.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    *[("BSD-3-Clause", [x for i in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names") for x in (*between, i)][len(between):])
      for between in ((), ("?",))],
    *[("BSD-2-Clause", [x for i in ("bsd-grant", "bsd-source", "bsd-binary") for x in (*between, i)][len(between):])
      for between in ((), ("?",))],
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("Apache-2.0", ["apache-2-the", "apache-obey", "apache-copy"]),
    ("Apache-2.0", ["apache-2-the", "apache-obey"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-2"]),
    ("Apache-2.0", ["apache-2-the"]),
    ("GPL-2.0-only", ["gpl-2-work"]),
    ("GPL-3.0-only", ["gpl-3-work"]),
    ("LGPL-3.0-only", ["lgpl-3-work"]),
    ("AGPL-3.0-only", ["agpl-3-work"]),
    ("MPL-2.0", ["mpl-2"]),
    ("BSD", ["bsd-grant"]),
    ("BSD-3-Clause", ["bsd-licensed"]),
    ("BSD-2-Clause", ["bsd-2-licensed"]),
    ("Apache-2.0", ["apache-head"]),
    ("BSL-1.0", ["bsl-1"]),
    ("Zlib", ["zlib-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SENTENCE_END = "[.!?;:]+[ \t\r\n]"
_BETWEEN = " ?\n[ \n]*"
#: What stands before the first word of a line (comment marks), and lines without words.
_MARKS = ("(?dm)^[^A-Za-z0-9.+\n]*(?:(?:rem|REM|dnl)[ \t\r]*)?$|"
          "^[^A-Za-z0-9\n]*(?:(?:rem|REM|dnl)[ \t][^A-Za-z0-9\n]*)?(?=[A-Za-z0-9])")
#: Every known notice holds one of these, or else its longest word is looked for; texts without any are not searched.
_ANCHORS = ("licen", "software", "redistribution", "released", "reserved", "attribution", "warranty", "permission")


def cut_words(original: str) -> str:
    """A notice's words, normalised and cut as texts are, with form feeds between its pieces."""
    pieces = re.split(_SENTENCE_END, original.translate(str.maketrans(_UPPER, _LOWER)) + "\n")
    pieces = [re.sub("[^a-z0-9.+]+", " ", x).strip() for x in pieces]
    return "\f".join(x for x in pieces if x)


def _gnu_and_others() -> tuple[dict[str, list[str]], list]:
    """Notices and rules that follow from the names above."""
    notices, rules = {}, []

    def add(identifier: str, licence: str, texts: list[str]) -> None:
        notices[identifier] = [*notices.get(identifier, []), *texts]
        if (licence, [identifier]) not in RULES + rules:
            rules.append((licence, [identifier]))

    for short, (name, versions) in GNU.items():
        for v in versions:
            spdx = f"{short}-{v if '.' in v else v + '.0'}"
            later = "gpl-free" if spdx == "GPL-3.0" else f"{short.lower()}-{v}-free"
            ends = [{"what": w, "a": a, "b": b, "name": name, "v": x} for w in SUBJECTS for a in ":;" for b in ",;"
                    for x in dict.fromkeys((v, spdx.split("-")[1]))]
            if later != "gpl-free":
                rules.append((f"{spdx}-or-later", [later, "gpl-hope"]))
            add(later, f"{spdx}-or-later", [_LATER.format(**e) for e in ends])
            add(f"{short.lower()}-{v}-only", f"{spdx}-only", [t.format(**e) for e in ends for t in _ONLY])
            add(f"{short.lower()}-{v}-work", f"{spdx}-only", [f"This work is licensed under the {name}, version {v}."])
            for kind, tags in (("only", ("-only", "")), ("or-later", ("-or-later", "+"))):
                add(f"spdx-{spdx}-{kind}".lower(), f"{spdx}-{kind}", [f"SPDX-License-Identifier: {spdx}{t}" for t in tags])
    for kind, words in CC_KINDS.items():
        add(f"cc-{kind}".lower(), f"CC-{kind}-4.0", [f"Licensed under CC {kind} 4.0."])
        full = f"Creative Commons {words} 4.0 International"
        add(f"cc-{kind}-name".lower(), f"CC-{kind}-4.0", [before + full + after for after in ("", " License", " Public License")
            for before in ("", "Licensed under ", "Licensed under a ", "Licensed under the ", "This work is licensed under a ",
                           "This work is licensed under the ")])
    for spdx in (*OTHER_SPDX, *(f"CC-{k}-4.0" for k in CC_KINDS)):
        add(f"spdx-{spdx}".lower(), spdx, [f"SPDX-License-Identifier: {spdx}"])
    return notices, rules


_MORE, _MORE_RULES = _gnu_and_others()
RULES += _MORE_RULES
#: Known sentences by identifier, each as one or more wordings, with form feeds between pieces.
KNOWN = {name: [s] for name, s in SENTENCES.items()}
for _name, _texts in [*NOTICES.items(), *_MORE.items()]:
    _cut = [cut_words(t.replace("{what}", w)) for t in _texts for w in (SUBJECTS if "{what}" in t else ("",))]
    KNOWN[_name] = list(dict.fromkeys([*KNOWN.get(_name, []), *_cut]))


def pieces(known: dict) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """(identifier of each piece, sequences of pieces with the identifier of the notice, longer ones
    first)."""
    wordings = [(name, w.split("\f")) for name, ws in known.items() for w in ([ws] if isinstance(ws, str) else ws)]
    one = {}
    for name, w in wordings:
        if len(w) == 1:
            one.setdefault(w[0], f"<{name}>")
    for _, w in wordings:
        for x in w:
            one.setdefault(x, f"<#{len(one)}>")
    many = {"".join(one[x] for x in w): f"<{name}>" for name, w in wordings if len(w) > 1}
    return one, sorted(many.items(), key=lambda x: (-x[0].count("<"), x[0]))


def _normal(text: str) -> F.Column:
    t = F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    return F.lower(F.regexp_replace(F.regexp_replace(t, _SENTENCE_END, "\n"), "[^A-Za-z0-9.+\n]+", " "))


def sentences(text: str = "text") -> F.Column:
    """Normalised sentences of a text column, cut at line ends too."""
    return _cut_lines(_normal(text))


def _cut_lines(normal: F.Column) -> F.Column:
    return F.filter(F.split(F.ltrim(normal), _BETWEEN), lambda s: s != "")


def _units(text: str) -> F.Column:
    """The normalised sentences of a text without comment marks; line feeds stand between their lines."""
    t = F.concat(F.lit("\n"), F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\f"), F.lit(" ")), F.lit("\n"))
    t = F.regexp_replace(F.regexp_replace(t, _MARKS, ""), _SENTENCE_END, "\f")
    t = F.lower(F.regexp_replace(F.regexp_replace(t, "\n\n+", "\f"), "[^A-Za-z0-9.+\n\f]+", " "))
    t = F.regexp_replace(F.regexp_replace(t, "[ \n]*\f[ \n\f]*", "\f"), " ?\n ?", "\n")
    return F.filter(F.split(t, "\f"), lambda u: ~F.trim(u).isin("", "\n"))


def _near(known: dict) -> F.Column:
    """Whether a text of such ``normal`` words can hold a known sentence."""
    wordings = [w for ws in known.values() for w in ([ws] if isinstance(ws, str) else ws)]
    anchors = {next((a for a in _ANCHORS if a in w), max(w.replace("\f", " ").split(" "), key=len)) for w in wordings}
    return F.exists(F.array(*map(F.lit, sorted(anchors))), lambda a: F.contains(F.col("normal"), a))


def _let(value: F.Column, use) -> F.Column:
    """``use(value)``, with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def identifiers(units: F.Column, known: dict) -> F.Column:
    """Identifiers of sentences as text, ``<id><id>``; runs of unknown sentences are one ``<?>``."""
    one, many = pieces(known)
    by_sentence = F.create_map(*[F.lit(x) for pair in one.items() for x in pair])
    heads: dict[str, list] = {}
    for piece in sorted(one, key=lambda x: (-len(x), x)):
        heads.setdefault(piece.split(" ")[0], []).append(F.struct(F.lit(piece).alias("s"), F.lit(one[piece]).alias("name")))
    by_head = F.create_map(*[x for word, found in heads.items() for x in (F.lit(word), F.array(*found))])
    most = max(len(piece.split(" ")) for piece in one)

    def starting(lines: F.Column, i: F.Column) -> F.Column:
        """The known run of whole lines from line ``i`` on: its name and number of lines."""
        rest = F.concat(F.array_join(F.slice(lines, i + 1, F.lit(most)), "\n"), F.lit("\n"))
        runs = _let(rest, lambda r: _let(F.replace(r, F.lit("\n"), F.lit(" ")), lambda flat: F.transform(
            F.filter(by_head[F.substring_index(lines[i], " ", 1)], lambda c: F.startswith(flat, c["s"]) & (
                F.substring(r, F.length(c["s"]) + 1, F.lit(1)) == "\n")),
            lambda c: F.struct(c["name"].alias("name"), F.regexp_count(
                F.substring(r, F.lit(1), F.length(c["s"])), F.lit("\n")).alias("more")))))
        return F.when(by_head[F.substring_index(lines[i], " ", 1)].isNotNull(), F.get(runs, F.lit(0)))

    def step(state: F.Column, x: F.Column) -> F.Column:
        unknown = F.when(F.endswith(state["names"], F.lit("<?>")), state["names"]).otherwise(F.concat(state["names"], F.lit("<?>")))
        return F.when(x["i"] < state["next"], state).when(x["run"].isNull(), F.struct(
            unknown.alias("names"), (x["i"] + 1).alias("next"))).otherwise(F.struct(
                F.concat(state["names"], x["run"]["name"]).alias("names"), (x["i"] + x["run"]["more"] + 1).alias("next")))

    def by_lines(unit: F.Column) -> F.Column:
        found = _let(F.filter(F.split(unit, "\n"), lambda x: x != ""), lambda lines: F.transform(
            lines, lambda line, i: F.struct(i.alias("i"), starting(lines, i).alias("run"))))
        return F.aggregate(found, F.struct(F.lit("").alias("names"), F.lit(0).alias("next")), step, lambda state: state["names"])

    def name(unit: F.Column) -> F.Column:
        return F.coalesce(by_sentence[F.trim(F.replace(unit, F.lit("\n"), F.lit(" ")))],
                          F.when(F.contains(F.trim(unit), F.lit("\n")), by_lines(F.trim(unit))), F.lit("<?>"))

    names = F.array_join(F.transform(units, name), "")
    if many:
        joined = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("name")) for p, n in many])
        names = F.aggregate(joined, names, lambda t, k: F.replace(t, k["p"], k["name"]))
    # two steps, as a repeated choice would recurse once for each sentence
    return F.regexp_replace(F.regexp_replace(names, "<#[0-9]+>", "<?>"), r"(<\?>)+", "<?>")


def scan(docs: DataFrame, known: dict = KNOWN, rules: list = RULES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, n_sentences, n_known, sequence, licences, n_unmatched): sequence of identifiers, the
    licences found (comma-joined), and the number of known sentences that no rule took.  ``known`` has
    the wordings of each identifier, normalised, with form feeds between pieces (``cut_words``)."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), _normal(text_col).alias("normal"))
    rows = rows.select(id_col, F.size(_cut_lines(F.col("normal"))).cast("long").alias("n_sentences"),
                       F.when(_near(known), F.col("text")).alias("text"))
    unknown = F.when(F.col("n_sentences") > 0, F.lit("<?>")).otherwise(F.lit(""))
    rows = rows.select(id_col, "n_sentences", F.when(F.col("text").isNull(), unknown).otherwise(
        identifiers(_units("text"), known)).alias("sequence"))
    patterns = F.array(*[F.struct(F.lit("".join(f"<{i}>" for i in ids)).alias("p"), F.lit(name).alias("name")) for name, ids in rules]).cast(
        "array<struct<p:string,name:string>>") if rules else F.expr("cast(array() as array<struct<p:string,name:string>>)")
    start = F.struct(F.col("sequence").alias("rest"), F.expr("cast(array() as array<string>)").alias("names"))

    def step(state: F.Column, rule: F.Column) -> F.Column:
        hit = F.contains(state["rest"], rule["p"])
        return F.struct(F.replace(state["rest"], rule["p"], F.lit("<!>")).alias("rest"),
                        F.when(hit, F.array_union(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"))

    rows = rows.withColumn("end", F.when(F.regexp_like("sequence", F.lit("<[^?]")), F.aggregate(patterns, start, step)).otherwise(start))
    return rows.select(id_col, "n_sentences", F.regexp_count("sequence", F.lit("<[^?]")).cast("long").alias("n_known"), "sequence",
                       F.array_join("end.names", ",").alias("licences"),
                       F.regexp_count("end.rest", F.lit("<[^?!]")).cast("long").alias("n_unmatched"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    one, many = pieces(KNOWN)
    case = " ".join(f"WHEN '{s}' THEN '{name}'" for s, name in one.items())
    joined = "seq"
    for sequence, name in many:
        joined = f"replace({joined}, '{sequence}', '{name}')"
    steps = ["seq AS (SELECT *, sequence AS r0, CAST([] AS VARCHAR[]) AS l0 FROM named)"]
    for i, (name, ids) in enumerate(RULES):
        p = "".join(f"<{x}>" for x in ids)
        steps.append(f"s{i} AS (SELECT doc_id, n_sentences, sequence, replace(r{i}, '{p}', '<!>') AS r{i + 1}, CASE WHEN "
                     f"contains(r{i}, '{p}') AND NOT list_contains(l{i}, '{name}') THEN list_append(l{i}, '{name}') ELSE l{i} END "
                     f"AS l{i + 1} FROM {'seq' if not i else f's{i - 1}'})")
    last = len(RULES)
    return f"""
    WITH flat AS (SELECT doc_id, regexp_replace(regexp_replace(translate(coalesce(text, '') || chr(10), '{_UPPER}', '{_LOWER}'),
                         '[.!?;:]+[ \\t\\r\\n]', chr(10), 'g'), '[^a-z0-9.+\\n]+', ' ', 'g') AS t FROM documents),
         cut AS (SELECT doc_id, list_filter(string_split_regex(ltrim(t, ' '), ' ?\\n[ \\n]*'), lambda s: s <> '') AS found FROM flat),
         ids AS (SELECT doc_id, CAST(len(found) AS BIGINT) AS n_sentences, array_to_string(list_transform(found,
                        lambda s: CASE s {case} ELSE '<?>' END), '') AS seq FROM cut),
         named AS (SELECT doc_id, n_sentences, regexp_replace({joined}, '(<\\?>|<#[0-9]+>)+', '<?>', 'g') AS sequence FROM ids),
         {", ".join(steps)}
    SELECT doc_id, n_sentences, CAST(len(regexp_extract_all(sequence, '<[^?]')) AS BIGINT) AS n_known, sequence,
           array_to_string(l{last}, ',') AS licences, CAST(len(regexp_extract_all(r{last}, '<[^?!]')) AS BIGINT) AS n_unmatched
    FROM s{last - 1}"""


QUERIES = {"op7_licence_scan": op7_licence_scan}
ORACLE = {"op7_licence_scan": _oracle()}
