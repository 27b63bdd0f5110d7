"""License scan by sentence rules.

A text is cut into sentences, those into a normal form, and known licence sentences into their
identifiers. The sequence of identifiers of a document is then matched against ordered rules: a
rule holds when its identifiers occur in their order, whatever other sentences stand between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences in normal form (lower case, signs as spaces).
SENTENCES = {
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit_liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl_free": "this program is free software",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "mpl_subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "all_rights": "all rights reserved",
}
# Names of licences, in normal form, after a lead such as "licensed under the".
NAMES = {
    "mit license": "MIT",
    "mit": "MIT",
    "expat license": "MIT",
    "apache license version 2 0": "Apache-2.0",
    "apache license 2 0": "Apache-2.0",
    "apache 2 0 license": "Apache-2.0",
    "apache license version 2 0 the license": "Apache-2.0",
    "isc license": "ISC",
    "unlicense": "Unlicense",
    "mozilla public license version 2 0": "MPL-2.0",
    "mozilla public license 2 0": "MPL-2.0",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "simplified bsd license": "BSD-2-Clause",
    "new bsd license": "BSD-3-Clause",
    "boost software license version 1 0": "BSL-1.0",
    "eclipse public license version 2 0": "EPL-2.0",
    "eclipse public license 2 0": "EPL-2.0",
}
LEAD = (
    r"^(?:(?:[^ ]+ ){0,12}(?:is|are) )?(?:licensed|released|distributed"
    r"|available|published|provided|made available|shared) under (?:the terms of )?(?:the |a |an )?"
)
# Licences of the GNU project and their versions, in normal form.
FAMILIES = {
    "gnu general public license": ("GPL", ("1.0", "2.0", "3.0")),
    "gnu lesser general public license": ("LGPL", ("2.1", "3.0")),
    "gnu affero general public license": ("AGPL", ("3.0",)),
}
# Versions that the notice with a semicolon names: "... Foundation; either version 2 ...".
CUT_NOTICES = {
    "gnu general public license": ("GPL", ("1.0", "2.0", "3.0")),
    "gnu library general public license": ("LGPL", ("2.0",)),
    "gnu lesser general public license": ("LGPL", ("2.0", "2.1", "3.0")),
    "gnu affero general public license": ("AGPL", ("3.0",)),
}
SPDX = "spdx license identifier "
# Headings of the licences' own texts, in normal form.
TITLES = {
    "apache license version 2 0 january 2004": "Apache-2.0",
    "version 2 0 january 2004": "Apache-2.0",
    "terms and conditions for use reproduction and distribution": "Apache-2.0",
    "gnu general public license version 2 june 1991": "GPL-2.0-only",
    "gnu general public license version 3 29 june 2007": "GPL-3.0-only",
    "gnu lesser general public license version 2 1 february 1999": "LGPL-2.1-only",
    "gnu lesser general public license version 3 29 june 2007": "LGPL-3.0-only",
    "gnu affero general public license version 3 19 november 2007": "AGPL-3.0-only",
}


def known() -> dict[str, str]:
    """Normal form -> identifier of every known sentence; names are led by "under "."""
    out = {text: name for name, text in SENTENCES.items()}
    names = dict(NAMES)
    for long, (short, versions) in FAMILIES.items():
        for v in versions:
            spdx = f"{short}-{v}"
            for said in {v, v.removesuffix(".0")}:
                said = said.replace(".", " ")
                for form in ("version {}", "v{}", "{}"):
                    names[f"{long} {form.format(said)}"] = f"{spdx}-only"
                    names[f"{short.lower()} {form.format(said)}"] = f"{spdx}-only"
                    names[f"{long} {form.format(said)} or later"] = f"{spdx}-or-later"
                asked = f"{long} as published by the free software foundation either version {said}"
                later = f"you can redistribute it and or modify it under the terms of the {asked}"
                for end in ("", " or at your option any later version"):
                    out[f"{later} of the license{end}"] = f"gpl_terms:{spdx}-or-later"
    for long, (short, versions) in CUT_NOTICES.items():
        terms = f"you can redistribute it and or modify it under the terms of the {long}"
        out[f"{terms} as published by the free software foundation"] = f"gpl_notice:{short}"
        for v in versions:
            for said in {v, v.removesuffix(".0")}:
                for end in ("", " or at your option any later version"):
                    form = f"either version {said.replace('.', ' ')} of the license{end}"
                    out[form] = f"gpl_version:{v}"
    kinds = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
    words = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
    for kind in kinds:
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            spdx = f"CC-{kind.upper().replace(' ', '-')}-{v}"
            number = v.replace(".", " ")
            long = " ".join(words[w] for w in kind.split())
            names[f"cc {kind} {number}"] = names[f"cc {kind} {number} license"] = spdx
            for place in ("international license", "unported license", "license", ""):
                names[f"creative commons {long} {number} {place}".strip()] = spdx
    names["cc0 1 0"] = names["cc0 1 0 universal"] = "CC0-1.0"
    out |= {f"under {said}": f"name:{spdx}" for said, spdx in names.items()}
    for spdx in sorted(set(names.values())):
        form = "".join(c if c.isalnum() else " " for c in spdx.lower())
        out[SPDX + form] = out[f"license {form}"] = f"name:{spdx}"
    for said, spdx in NAMES.items():
        if said.endswith("license"):  # "License: MIT License", and a badge that links the file
            out[f"license {said}"] = out[f"{said} license"] = f"name:{spdx}"
    return out | {title: f"name:{spdx}" for title, spdx in TITLES.items()}


def older() -> dict[str, str]:
    """Like known(): the ends of older notices, which do not say "of the License"."""
    ends = {k: v for k, v in known().items() if v.startswith("gpl_version:")}
    return {k.replace(" of the license", ""): v for k, v in ends.items()}


def rules() -> list[tuple[str, list[str]]]:
    """(licence, identifiers in order); two joined by "|" follow each other directly."""
    named = sorted({v for v in known().values() if v.startswith(("name:", "gpl_terms:"))})
    out = [(v.partition(":")[2], [v]) for v in named]
    cut = sorted({(short, v) for short, versions in CUT_NOTICES.values() for v in versions})
    return [
        *out,
        *((f"{short}-{v}-or-later", [f"gpl_notice:{short}|gpl_version:{v}"]) for short, v in cut),
        ("MIT", ["mit_grant", "mit_notice"]),
        ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
        ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
        ("ISC", ["isc_grant", "isc_as_is"]),
        ("Apache-2.0", ["apache_use", "apache_basis"]),
        ("Unlicense", ["unlicense_free"]),
        ("MPL-2.0", ["mpl_subject"]),
        ("all rights reserved", ["all_rights"]),
    ]


# A rule gives way where one with more sentences holds.
YIELDS = {"BSD-2-Clause": "BSD-3-Clause"}

# Ends of sentences and blank lines become this sign, which also parts the known sentences.
HARD = "\x1e"
_ENDS = r"(?<=[.!?;:])\s+|\s*\n\s*\n\s*"
# After these a colon ends no sentence: what follows on the line belongs to them.
_TAG = r"(?im)((?:spdx-license-identifier|^[^\p{L}\p{N}\n]*licen[sc]e):)[ \t]+"
# The parts of a licence expression; "or later" is no "or".
_OPERATOR = " (?:or|and) "


def normal_form(sentence: Column) -> Column:
    """Lower case, every other run of signs as one space, a lead to a name as "under "."""
    flat = F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))
    flat = F.regexp_replace(flat, r"^\d+ (?=redistributions|neither)", "")
    return F.regexp_replace(flat, LEAD, "under ")


def _parts(form: Column) -> Column:
    """A line's form, or one for each licence of a tag's expression, without exceptions."""
    said = F.replace(F.substring(form, len(SPDX) + 1, 1 << 20), F.lit(" or later"), F.lit(" or-later"))
    each = F.transform(
        F.split(said, _OPERATOR),
        lambda x: F.concat(
            F.lit(SPDX),
            F.regexp_replace(F.replace(x, F.lit("or-later"), F.lit("or later")), " with .*", ""),
        ),
    )
    return F.when(F.startswith(form, F.lit(SPDX)), each).otherwise(F.array(form))


def _matched(text: Column) -> Column:
    """Array of (sentence, id): known sentences in order, by number of their sentence from 0.

    A sentence may run over several lines; where the whole is not known its lines are tried.
    """
    table = known() | older()
    pairs = F.map_from_arrays(
        F.split(F.lit(HARD.join(table)), HARD), F.split(F.lit(HARD.join(table.values())), HARD)
    )
    tagged = F.regexp_replace(text, _TAG, "$1")
    cut = F.split(F.regexp_replace(tagged, _ENDS, HARD), HARD)

    def one(s: Column, i: Column) -> Column:
        whole = F.try_element_at(pairs, normal_form(s))
        lines = F.flatten(F.transform(F.split(s, "\n"), lambda x: _parts(normal_form(x))))
        found = F.transform(lines, lambda x: F.try_element_at(pairs, x))
        ids = F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array_compact(found))
        return F.transform(ids, lambda x: F.struct(i.alias("sentence"), x.alias("id")))

    return F.flatten(F.transform(cut, one))


def _pattern(ids: list[str]) -> str:
    """Identifiers in order in a sequence that is written "|a|b|c|"."""
    escaped = [i.replace(".", r"\.").replace("|", r"\|") for i in ids]
    return r"\|" + r"\|(?:[^|]+\|)*".join(escaped) + r"\|"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, licenses (sorted names joined by " + ", empty if
    none), n_sentences (known licence sentences, LONG) and matches (array of sentence, id).

    Null and empty texts have no licence. Repeated rows are scanned alike; an empty table
    gives an empty one. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = docs.select(F.col(id_col).alias("id"), _matched(text).alias("matches"))
    sequence = F.concat(
        F.lit("|"), F.array_join(F.transform("matches", lambda m: m["id"]), "|"), F.lit("|")
    )
    held: dict[str, Column] = {}
    for name, ids in rules():
        found = F.col("sequence").rlike(_pattern(ids))
        held[name] = held[name] | found if name in held else found
    names = [
        F.when(found & ~held[YIELDS[name]] if name in YIELDS else found, F.lit(name))
        for name, found in sorted(held.items())
    ]
    found = F.when(
        F.size("matches") > 0, F.array_join(F.array_compact(F.array(*names)), " + ")
    ).otherwise(F.lit(""))
    return scanned.withColumn("sequence", sequence).select(
        F.col("id").alias(id_col),
        found.alias("licenses"),
        F.size("matches").cast("long").alias("n_sentences"),
        "matches",
    )


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL for (doc_id, licenses, n_sentences)."""

    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def norm(x: str) -> str:
        flat = rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
        flat = rf"regexp_replace({flat}, '^\d+ (redistributions|neither)', '\1')"
        return f"regexp_replace({flat}, {quote(LEAD)}, 'under ')"

    pairs = ",\n".join(f"({quote(a)}, {quote(b)})" for a, b in (known() | older()).items())
    lines = ",\n".join(
        f"({i}, {quote(name)}, {quote(_pattern(ids))})" for i, (name, ids) in enumerate(rules())
    )
    yields = " OR ".join(
        f"(name = {quote(a)} AND list_contains(names, {quote(b)}))" for a, b in YIELDS.items()
    )
    # RE2 has no look-behind: the sign that ends a sentence is kept by its group.
    return rf"""
        WITH known(form, ident) AS (VALUES {pairs}),
        rule(no, name, pattern) AS (VALUES {lines}),
        text AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {documents}),
        tagged AS (SELECT r, regexp_replace(t, {quote(_TAG)}, '\1', 'g') AS t FROM text),
        cut AS (
          SELECT r, unnest(range(len(parts))) AS s, unnest(parts) AS part
          FROM (SELECT r, string_split(regexp_replace(regexp_replace(t,
                  '\s*\n\s*\n\s*', chr(30), 'g'), '([.!?;:])\s+', '\1' || chr(30), 'g'), chr(30)) AS parts
                FROM tagged)),
        whole AS (
          SELECT r, s, part, ident FROM cut LEFT JOIN known ON form = {norm("part")}),
        line AS (
          SELECT r, s, l, {norm("part")} AS said
          FROM (SELECT r, s, unnest(range(len(x))) AS l, unnest(x) AS part
                FROM (SELECT r, s, string_split(part, chr(10)) AS x FROM whole WHERE ident IS NULL))),
        part AS (
          SELECT r, s, l, unnest(range(len(x))) AS o, unnest(x) AS said
          FROM (SELECT r, s, l, CASE WHEN NOT starts_with(said, '{SPDX}') THEN [said] ELSE
                  ['{SPDX}' || regexp_replace(replace(y, 'or-later', 'or later'), ' with .*', '')
                   FOR y IN string_split_regex(replace(said[{len(SPDX) + 1}:], ' or later', ' or-later'),
                                               '{_OPERATOR}')] END AS x
                FROM line)),
        hit AS (
          SELECT r, s, 0 AS l, 0 AS o, ident FROM whole WHERE ident IS NOT NULL
          UNION ALL
          SELECT r, s, l, o, ident FROM part JOIN known ON form = said),
        seq AS (
          SELECT r, count(*) AS n, '|' || string_agg(ident, '|' ORDER BY s, l, o) || '|' AS ids
          FROM hit GROUP BY r),
        held AS (
          SELECT r, list(DISTINCT name) AS names FROM seq JOIN rule
          ON regexp_matches(ids, pattern) GROUP BY r),
        kept AS (
          SELECT r, string_agg(name, ' + ' ORDER BY name) AS licenses
          FROM (SELECT r, names, unnest(names) AS name FROM held)
          WHERE NOT ({yields}) GROUP BY r)
        SELECT doc_id, coalesce(licenses, '') AS licenses,
               CAST(coalesce(n, 0) AS BIGINT) AS n_sentences
        FROM text LEFT JOIN seq USING (r) LEFT JOIN kept USING (r)
    """
