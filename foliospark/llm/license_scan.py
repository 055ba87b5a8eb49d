"""Licence scans by sentence rules.

A text is cut into sentences (at line ends too), these are normalised (ASCII letters and digits in lower case, all else a
space) and looked up among known licence sentences. A known sentence may go over several consecutive pieces, since lines are wrapped
and ``;`` and ``:`` cut; comment leaders are spaces. The identifiers found, in order of their first pieces, are matched against
rules, each an ordered sequence of identifiers that may have others between them.

Known sentences are looked up through a prefix tree of their characters, so a line costs the characters it shares with some
sentence, however many sentences there are. Everything is a projection of native expressions: a scan reads each text once and shuffles nothing.

Sentences that name a licence are built from openings (``OPENINGS``) and names (``NAMES``), grants of the GNU family from their
versions. ``SPDX-License-Identifier`` lines give one identifier for each licence of their expression; an expression with an
unknown licence gives none, an exception after ``WITH`` is passed over, and a ``+`` counts as a space.

Defined results: a null or empty text has no sentence and no licence; a sentence that comes several times gives its
identifier each time; where several known sentences begin with one piece, the longest counts; n_sentences counts pieces; a text
that meets several rules lists all its licences in alphabetical order (three-clause BSD texts hold the two clauses, too); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licences and the names that texts give them, normalised.
NAMES = {
    "0BSD": ("the zero clause bsd license", "the bsd zero clause license"),
    "AFL-3.0": ("the academic free license version 3 0", "the academic free license 3 0"),
    "AGPL-3.0": ("the gnu affero general public license version 3", "the gnu affero general public license v3 0", "the gnu agplv3", "the agplv3", "agplv3"),
    "Apache-1.1": ("the apache software license version 1 1", "the apache license version 1 1"),
    "Apache-2.0": ("the apache license version 2 0", "the apache license 2 0", "apache license 2 0", "apache license version 2 0", "the apache 2 0 license", "apache 2 0", "the apache software license version 2 0"),
    "Artistic-2.0": ("the artistic license 2 0", "the artistic license version 2 0"),
    "Beerware": ("the beer ware license",),
    "BSD-2-Clause": ("the bsd 2 clause license", "the 2 clause bsd license", "the simplified bsd license", "the bsd 2 clause simplified license"),
    "BSD-3-Clause": ("the bsd 3 clause license", "the 3 clause bsd license", "the new bsd license", "the modified bsd license"),
    "BSD-4-Clause": ("the bsd 4 clause license", "the original bsd license"),
    "BSL-1.0": ("the boost software license version 1 0", "the boost software license 1 0"),
    "BUSL-1.1": ("the business source license 1 1", "the business source license version 1 1"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal", "the creative commons cc0 1 0 universal license", "the cc0 1 0 universal public domain dedication"),
    "CC-BY-3.0": ("cc by 3 0", "a creative commons attribution 3 0 unported license", "the creative commons attribution 3 0 license"),
    "CC-BY-4.0": ("cc by 4 0", "a creative commons attribution 4 0 international license", "the creative commons attribution 4 0 international license", "the creative commons attribution 4 0 license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license", "the creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0", "a creative commons attribution noncommercial noderivatives 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "a creative commons attribution noncommercial sharealike 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "a creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-SA-3.0": ("cc by sa 3 0", "a creative commons attribution sharealike 3 0 unported license", "the creative commons attribution sharealike license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license", "the creative commons attribution sharealike 4 0 international license"),
    "CDDL-1.0": ("the common development and distribution license version 1 0", "the common development and distribution license"),
    "CECILL-2.1": ("the cecill license version 2 1", "the cecill 2 1 license"),
    "CPL-1.0": ("the common public license version 1 0", "the common public license 1 0"),
    "ECL-2.0": ("the educational community license version 2 0", "the educational community license 2 0"),
    "EPL-1.0": ("the eclipse public license version 1 0", "the eclipse public license v1 0", "the eclipse public license 1 0"),
    "EPL-2.0": ("the eclipse public license version 2 0", "the eclipse public license v2 0", "the eclipse public license 2 0"),
    "EUPL-1.2": ("the european union public licence version 1 2", "the eupl version 1 2", "the european union public licence v 1 2"),
    "GFDL-1.3": ("the gnu free documentation license version 1 3", "the gnu free documentation license 1 3"),
    "GPL-2.0": ("the gnu general public license version 2", "the gnu general public license v2 0", "the gnu general public license v2", "the gnu gpl version 2", "the gnu gplv2", "the gplv2", "gplv2", "gpl 2 0", "the gpl version 2", "gpl version 2"),
    "GPL-3.0": ("the gnu general public license version 3", "the gnu general public license v3 0", "the gnu general public license v3", "the gnu gpl version 3", "the gnu gplv3", "the gplv3", "gplv3", "gpl 3 0", "the gpl version 3", "gpl version 3"),
    "ISC": ("the isc license", "isc license"),
    "JSON": ("the json license",),
    "LGPL-2.1": ("the gnu lesser general public license version 2 1", "the gnu lesser general public license v2 1", "the lgpl version 2 1", "the lgplv2 1", "lgplv2 1", "lgpl 2 1"),
    "LGPL-3.0": ("the gnu lesser general public license version 3", "the gnu lesser general public license v3 0", "the lgpl version 3", "the lgplv3", "lgplv3", "lgpl 3 0"),
    "LPPL-1.3c": ("the latex project public license", "the latex project public license version 1 3c"),
    "MIT": ("the mit license", "mit license", "the mit licence", "an mit license", "the mit x11 license"),
    "MIT-0": ("the mit no attribution license", "the mit 0 license"),
    "MPL-1.1": ("the mozilla public license version 1 1", "the mozilla public license 1 1"),
    "MPL-2.0": ("the mozilla public license version 2 0", "the mozilla public license 2 0", "the mozilla public license v 2 0", "the mozilla public license v2 0", "the mpl 2 0", "mpl 2 0"),
    "MS-PL": ("the microsoft public license", "the microsoft public license ms pl"),
    "MS-RL": ("the microsoft reciprocal license", "the microsoft reciprocal license ms rl"),
    "NCSA": ("the university of illinois ncsa open source license", "the university of illinois open source license"),
    "ODbL-1.0": ("the open database license", "the open data commons open database license"),
    "OFL-1.1": ("the sil open font license version 1 1", "the sil open font license"),
    "OpenSSL": ("the openssl license",),
    "OSL-3.0": ("the open software license version 3 0", "the open software license 3 0"),
    "PHP-3.01": ("the php license version 3 01", "version 3 01 of the php license"),
    "PostgreSQL": ("the postgresql license", "the postgresql licence"),
    "PSF-2.0": ("the python software foundation license", "the psf license"),
    "Ruby": ("the ruby license", "the same terms as ruby"),
    "SSPL-1.0": ("the server side public license version 1", "the server side public license"),
    "Unlicense": ("the unlicense",),
    "UPL-1.0": ("the universal permissive license version 1 0", "the universal permissive license v 1 0"),
    "Vim": ("the vim license",),
    "W3C": ("the w3c software notice and license", "the w3c license"),
    "WTFPL": ("the wtfpl", "the do what the fuck you want to public license"),
    "X11": ("the x11 license", "the mit x consortium license"),
    "Zlib": ("the zlib license", "the zlib libpng license"),
}
# What stands before a name, normalised.
OPENINGS = ("licensed under", "released under", "distributed under", "available under", "published under") + tuple(
    f"this {what} is {how} under" for what in ("project", "file", "work", "software", "program", "library", "package", "code", "repository", "module") for how in ("licensed", "released", "distributed")
)
# Key sentences of public licences, normalised, with their identifiers.
KEYS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit.grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit.notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit.warranty",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache.grant",
    "you may not use this file except in compliance with the license": "apache.comply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache.where",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache.warranty",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl.warranty",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl.warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd.grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd.binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd.advertise",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd.endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd.grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc.warranty",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl.subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl.where",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl.where",
    "this is free and unencumbered software released into the public domain": "unlicense.grant",
    "this software is provided as is without any express or implied warranty": "zlib.warranty",
    "the origin of this software must not be misrepresented": "zlib.origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib.altered",
    "this notice may not be removed or altered from any source distribution": "zlib.notice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost.grant",
    "all rights reserved": "rights.reserved",
}
# Ordered rules (licence, identifiers) for the key sentences.
KEY_RULES = [
    ("0BSD", ("0bsd.grant", "isc.warranty")),
    ("Apache-2.0", ("apache.grant",)),
    ("Apache-2.0", ("apache.comply", "apache.where")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-4-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.advertise")),
    ("BSL-1.0", ("boost.grant",)),
    ("ISC", ("isc.grant", "isc.warranty")),
    ("MIT", ("mit.grant", "mit.notice", "mit.warranty")),
    ("MPL-2.0", ("mpl.subject",)),
    ("Unlicense", ("unlicense.grant",)),
    ("Zlib", ("zlib.warranty", "zlib.origin", "zlib.altered", "zlib.notice")),
]
# The GNU family (licence, its name in grants, its version there).
GNU = [
    ("AGPL-3.0", "affero general", "3"),
    ("GPL-2.0", "general", "2"),
    ("GPL-3.0", "general", "3"),
    ("LGPL-2.1", "lesser general", "2 1"),
    ("LGPL-3.0", "lesser general", "3"),
]
SPDX_LINE = "spdx license identifier"


def normal(name: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", name.lower()))


def key_of(licence: str) -> str:
    return normal(licence).replace(" ", "_")


def _built() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]], dict[str, str]]:
    """Known sentences, rules, and the licences that expressions may name."""
    known, rules = dict(KEYS), list(KEY_RULES)
    spdx = {normal(x): x for x in NAMES}
    for licence, names in NAMES.items():
        known |= {f"{opening} {name}": f"{key_of(licence)}.name" for opening in OPENINGS for name in names}
    for licence, family, version in GNU:
        later = f"{licence}-or-later"
        spdx |= {normal(f"{licence}-only"): licence, normal(later): later}
        known |= {f"{opening} {name} or later": f"{key_of(later)}.name" for opening in OPENINGS for name in NAMES[licence]}
        known |= {f"{opening} {name} or any later version": f"{key_of(later)}.name" for opening in OPENINGS for name in NAMES[licence]}
        for what in ("program", "library", "software"):
            free = f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu {family} public license"
            known[f"{free} as published by the free software foundation either version {version} of the license or at your option any later version"] = f"{key_of(later)}.grant"
            known[f"{free} version {version} as published by the free software foundation"] = f"{key_of(licence)}.grant"
        rules += [(later, (f"{key_of(later)}.name",)), (later, (f"{key_of(later)}.grant", "gpl.warranty")), (licence, (f"{key_of(licence)}.grant",))]
    rules += [(licence, (f"{key_of(licence)}.name",)) for licence in NAMES]
    rules += [(licence, (f"spdx.{name.replace(' ', '_')}",)) for name, licence in spdx.items()]
    return known, sorted(rules), spdx


SENTENCES, RULES, SPDX = _built()


def sentences(text: str = "text") -> Column:
    """The normalised sentences of a text that are not empty, in order."""
    cut = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "([.!?;:])[ \\t\\r\\n\\f]+", "$1\n")
    plain = F.lower(F.regexp_replace(cut, "[^A-Za-z0-9\\n]+", " "))
    return F.filter(F.transform(F.split(plain, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def prefix_tree(sentences_: list[str], space: str = " ") -> str:
    """A pattern for any of the sentences, the longest that fits first: no two branches of a node begin with one character."""

    def node(tails: list[str]) -> str:
        ends, branches = "" in tails, {}
        for tail in tails:
            if tail:
                branches.setdefault(tail[0], []).append(tail)
        parts = []
        for group in branches.values():
            n = next((i for i, chars in enumerate(zip(*group)) if len(set(chars)) > 1), min(map(len, group)))
            parts.append(group[0][:n].replace(" ", space) + node([t[n:] for t in group]))
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)}{'|' if ends else ''})" if ends or len(parts) > 1 else parts[0]

    return node(sorted(set(sentences_)))


def _pattern(identifiers: tuple[str, ...]) -> str:
    return " " + " (.* )?".join(i.replace(".", "[.]") for i in identifiers) + " "


def _looked_up(values: dict, kind: str, key: Column) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")[key]


def license_scan(docs: DataFrame, known: dict[str, str] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None, spdx: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_sentences, sentence_ids (in order, spaces between) and licenses (commas between) of every row.

    ``known``: normalised sentences and their identifiers; ``rules``: licences and the identifiers they ask for, in order; ``spdx``:
    what expressions may name, normalised. An identifier ``spdx.x`` stands for the name x there.
    """
    known, rules, spdx = known or SENTENCES, rules or RULES, SPDX if spdx is None else spdx
    any_known = prefix_tree(list(known), "[ \\n]")
    if spdx:
        one = prefix_tree(list(spdx))
        passed = "(?: with (?:(?! or | and )[a-z0-9 ])+)?"
        any_known += f"|{SPDX_LINE}[ \\n]{one}{passed}(?: (?:or|and) {one}{passed})*"
    # Looked at ahead, so a sentence may begin within another; each space may be the end of a piece.
    pieces = F.concat(F.lit("\n"), F.array_join("s", "\n"), F.lit("\n"))
    hits = F.transform(F.regexp_extract_all(pieces, F.lit(f"\\n(?=({any_known})\\n)"), F.lit(1)), lambda s: F.translate(s, "\n", " "))
    identifiers = lambda s: F.array(_looked_up(known, "string", s))
    if spdx:
        named = lambda s: F.regexp_extract_all(s, F.lit(f"(?:{SPDX_LINE}| or| and) ({one})(?= or | and | with |$)"), F.lit(1))
        plain = identifiers
        identifiers = lambda s: F.when(s.startswith(SPDX_LINE), F.transform(named(s), lambda x: F.concat(F.lit("spdx."), F.translate(x, " ", "_")))).otherwise(plain(s))
    found = docs.select("doc_id", sentences().alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.flatten(F.transform(hits, identifiers)).alias("ids"))
    single: dict[str, list[str]] = {}
    for name, ids in rules:
        if len(ids) == 1:
            single.setdefault(ids[0], []).append(name)
    alone = F.flatten(F.transform("ids", lambda i: F.coalesce(_looked_up(single, "array<string>", i), F.array().cast("array<string>"))))
    padded = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    ordered = F.array_compact(F.array(*[F.when(padded.rlike(_pattern(ids)), F.lit(name)) for name, ids in rules if len(ids) > 1], F.lit(None).cast("string")))
    met = F.array_sort(F.array_distinct(F.concat(alone, ordered)))
    return found.select("doc_id", "n_sentences", F.array_join("ids", " ").alias("sentence_ids"), F.when(F.size("ids") > 0, F.array_join(met, ",")).otherwise("").alias("licenses"))
