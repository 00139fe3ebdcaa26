"""Licence scans by sentence rules.

Each text is cut into sentences, wrapped and commented lines joined, the
sentences are normalised, and those that a table knows become identifiers. Licence rules are ordered: each is a sequence of
identifiers that must stand in this order in a text, others between them
allowed. All of it is one projection of the row: no shuffle, no join, and the
known tables are constants of a few dozen entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm._common import ascii_lower

#: Normalised sentences of well-known licence texts and notices, and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "licensed under the apache license version 2 0": "apache2-notice",
    "licensed under the apache license version 2 0 the license": "apache2-notice",
    "you may not use this file except in compliance with the license": "apache2-condition",
    "you may obtain a copy of the license at": "apache2-copy",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-grant",
    "either version 3 of the license or at your option any later version": "gpl3-or-later",
    "either version 2 of the license or at your option any later version": "gpl2-or-later",
    "licensed under cc by nc 4 0": "cc-by-nc4-notice",
    "licensed under cc by 4 0": "cc-by4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa4-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by4-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all rights reserved": "reserved-notice",
}
#: Whole sentences of the texts as they are published, with the variants in use; the SQL has only those above.
WHOLE_SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-condition",
    **{f"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and {x}": "mit-warranty" for x in ("noninfringement", "non infringement")},
    **{f"neither the name of {x} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse" for x in ("the copyright holder", "the copyright holders", "the copyright owner", "the author", "the organization", "the university", "the project", "the company")},
    "neither the name of the copyright holder nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-grant",
    **{f"{begin}you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {n} of the license or at your option any later version": f"gpl{n}-or-later-grant" for begin in ("", "this program is free software ") for n in (2, 3)},
    **{f"you may obtain a copy of the license at {x} www apache org licenses license 2 0": "apache2-copy" for x in ("http", "https")},
}
#: Licence rules in order of precedence: (licence, identifiers in the order they must have).
LICENSE_RULES = [
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-grant", "gpl3-or-later"]),
    ("GPL-2.0-or-later", ["gpl-grant", "gpl2-or-later"]),
    ("Apache-2.0", ["apache2-notice", "apache2-condition", "apache2-copy"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("MIT", ["mit-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-notice"]),
    ("CC-BY-4.0", ["cc-by4-notice"]),
    ("All-rights-reserved", ["reserved-notice"]),
]
#: The same with the rules of whole sentences, each before the rule that it is closest to.
_WHOLE_RULES = {
    "BSD-2-Clause": ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    "GPL-3.0-or-later": ("GPL-3.0-or-later", ["gpl3-or-later-grant"]),
    "GPL-2.0-or-later": ("GPL-2.0-or-later", ["gpl2-or-later-grant"]),
}
#: What other published texts say, a sentence each that only they have, and what its identifier stands for.
_ISC = "permission to use copy modify and{} distribute this software for any purpose with or without fee is hereby granted"
_TO_GNU = "{begin}you can redistribute it and or modify it under the terms of the gnu {name} general public license as published by the free software foundation"
OTHER_SENTENCES = {
    **{f"{_ISC.format(x)} provided that the above copyright notice and this permission notice appear in all copies": "isc-grant" for x in ("", " or")},
    **{_ISC.format(x): "0bsd-grant" for x in ("", " or")},
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-notice",
    **{f"if a copy of the mpl was not distributed with this file you can obtain one at {x} mozilla org mpl 2 0": "mpl2-copy" for x in ("http", "https")},
    **{_TO_GNU.format(begin=b, name="lesser"): "lgpl-grant" for b in ("", "this library is free software ", "this program is free software ")},
    "either version 2 1 of the license or at your option any later version": "lgpl21-or-later",
    **{f"{_TO_GNU.format(begin=b, name=name)} either version 3 of the license or at your option any later version": f"{tag}-or-later-grant" for b in ("", "this library is free software ", "this program is free software ") for name, tag in (("lesser", "lgpl3"), ("affero", "agpl3"))},
    "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    **{f"this work is licensed under {article} creative commons {name} 4 0 international license": f"cc-{tag}4-work" for article in ("a", "the") for name, tag in (("attribution sharealike", "by-sa"), ("attribution noncommercial", "by-nc"), ("attribution noderivatives", "by-nd"), ("attribution noncommercial sharealike", "by-nc-sa"), ("attribution noncommercial noderivatives", "by-nc-nd"))},
    "this work is licensed under the creative commons attribution 4 0 international license": "cc-by4-notice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl1-grant",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl-grant",
}
#: Identifiers of version lists that are no longer used, and those that say the same.
_SPDX_OLD = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}
_SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "ISC", "0BSD", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0", "CC0-1.0", "WTFPL"]
OTHER_SENTENCES |= {"spdx license identifier " + x.lower().replace("-", " ").replace(".", " "): "spdx-" + _SPDX_OLD.get(x, x).lower() for x in (*_SPDX, *_SPDX_OLD)}
OTHER_SENTENCES |= {f"licensed under {x}": "apache2-notice" for x in ("the apache license 2 0", "apache license 2 0", "apache license version 2 0", "the apache 2 0 license")}
OTHER_SENTENCES |= {_TO_GNU.format(begin=b, name="affero"): "agpl-grant" for b in ("", "this program is free software ")}
OTHER_RULES = [
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("Unlicense", ["unlicense-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("MPL-2.0", ["mpl2-notice", "mpl2-copy"]),
    ("LGPL-2.1-or-later", ["lgpl-grant", "lgpl21-or-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-or-later-grant"]),
    ("LGPL-3.0-or-later", ["lgpl-grant", "gpl3-or-later"]),
    ("AGPL-3.0-or-later", ["agpl3-or-later-grant"]),
    ("AGPL-3.0-or-later", ["agpl-grant", "gpl3-or-later"]),
    ("CC0-1.0", ["cc0-waiver"]),
    *[(f"CC-{x.upper()}-4.0", [f"cc-{x}4-work"]) for x in ("by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")],
    ("BSL-1.0", ["bsl1-grant"]),
    ("WTFPL", ["wtfpl-grant"]),
    *[(x, ["spdx-" + x.lower()]) for x in _SPDX],
]
ALL_RULES = [r for rule in LICENSE_RULES for r in (_WHOLE_RULES.get(rule[0]), rule) if r]
#: A reservation of all rights is the weakest of them.
ALL_RULES = [*ALL_RULES[:-1], *OTHER_RULES, ALL_RULES[-1]]
#: What isn't a word: typographic quotes are left out like the plain ones.
NOT_WORD = "[^a-z0-9\\x{80}-\\x{2017}\\x{2020}-\\x{10FFFF}]+"
_NO_WORD = "[^a-z0-9\\x{80}-\\x{10FFFF}\\n]*"
#: A sentence ends at . ! ? ; before white space, at a line without words (those of comment leaders too), and at the colon of a grant or of a list of conditions.
SENTENCE_END = f"[.!?;][\\x20\\t\\n\\r]+|\\n{_NO_WORD}(?:(?:dnl|rem){_NO_WORD})?\\n|(?<=free software|conditions are met):"
#: Comment leaders that are words.
_LEADER = "(?:^|[\\n\\r])[\\x20\\t]*(?:dnl|rem)[\\x20\\t]"
#: Sentences with an open place, as expressions over normalised ones, and the known sentence that each stands for: the owner of a BSD clause, of whom a full stop may cut off the first part, and what a notice speaks of.
_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission"
_OPEN = [
    (f"^(?:.+ )?nor the names of (?:its |their )?contributors {_ENDORSE}$", f"neither the name of the copyright holder nor the names of its contributors {_ENDORSE}"),
    ("^(?:this|the) (?:[a-z0-9]+ ){1,3}(?:is|are) (?:licensed|released|distributed|made available) under (?:the terms of )?(?=the mit|the apache|apache|cc )", "licensed under "),
]
_SPDX_LINE = "spdx license identifier "


def sentence_ids(text: Column, known: dict[str, str] | None = None) -> Column:
    """The identifiers of known sentences in order, repeats included. Null and empty texts give an empty array.

    A sentence over several lines is looked up whole; one that the table lacks
    is looked up line by line, and from each line on to its end, as headings
    and notices on lines of their own often have no full stop.
    """
    known = SENTENCES | WHOLE_SENTENCES | OTHER_SENTENCES if known is None else known
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    # few sentences are of a length that the table has
    longest, shortest = max(map(len, known)), min(map(len, known))

    def fits(s: Column) -> Column:
        return (F.length(s) >= shortest) & ((F.length(s) <= 2 * longest) | (F.length(F.regexp_replace(s, NOT_WORD, " ")) <= 2 * longest))

    def normal(s: Column) -> Column:
        later = F.when(s.contains("spdx-license-identifier"), F.regexp_replace(s, "([0-9])\\+", "$1-or-later")).otherwise(s)
        return F.trim(F.regexp_replace(F.regexp_replace(later, _LEADER, " "), NOT_WORD, " "))

    def opened(s: Column) -> Column:
        for of, to in _OPEN:
            s = F.regexp_replace(s, of, to)
        return s

    def look(s: Column) -> Column:
        """The identifiers of a sentence, none or one, but for expressions of SPDX, which name several."""
        n = F.transform(F.array(s), normal)  # an array of one, so that the text is normalised once
        known_as = F.transform(n, lambda x: F.coalesce(F.try_element_at(pairs, x), F.when(x.rlike("^(?:this|the) .* under |nor the names of "), F.try_element_at(pairs, opened(x)))))
        several = F.flatten(F.transform(n, lambda x: F.when(x.startswith(_SPDX_LINE) & x.rlike(" (or|and) (?!later)"), F.transform(F.split(F.substring(x, len(_SPDX_LINE) + 1, 500), " (?:or|and) (?!later)"), lambda part: F.try_element_at(pairs, F.concat(F.lit(_SPDX_LINE), part)))).otherwise(F.array().cast("array<string>"))))
        return F.when(fits(s), F.filter(F.concat(known_as, several), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))

    def found(*ids: Column) -> Column:
        return F.flatten(F.array(*ids))

    def by_lines(lines: Column) -> Column:
        def from_line(x: Column, i: Column) -> Column:
            left = F.size(lines) - i
            return found(look(x), F.when((i > 0) & (left > 1), look(F.array_join(F.slice(lines, i + 1, left), "\n"))).otherwise(F.array().cast("array<string>")))

        return F.flatten(F.transform(lines, from_line))

    def of_sentence(s: Column) -> Column:
        whole = found(look(s))
        return F.when(~s.rlike("[\\n\\r]") | (F.size(whole) > 0), whole).otherwise(F.flatten(F.transform(F.array(F.split(s, "[\\n\\r]+")), by_lines)))

    sentences = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SENTENCE_END)
    likely = F.filter(sentences, lambda s: fits(s) | ((F.length(s) > 2 * longest) & s.rlike("[\\n\\r]")))
    return F.flatten(F.transform(likely, of_sentence))


def scan_licenses(docs: DataFrame, known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(doc_id, sentence_ids, licenses, license) for each row of ``docs`` (doc_id, text).

    ``sentence_ids`` is the comma-joined identifier sequence, ``licenses`` the
    sorted licences whose rules match, and ``license`` the first by the rules'
    order, null without a match. A null text has no sentences. Repeated rows
    come back as often; extra columns are left aside.
    """
    ids = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    found = [(name, ids.rlike(".*".join(f",{x}(?=,)" for x in seq))) for name, seq in (ALL_RULES if rules is None else rules)]
    names = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(hit, name) for name, hit in found]), lambda x: x.isNotNull())))
    first = F.coalesce(*[F.when(hit, name) for name, hit in found])
    # the sequence is computed once, by row, before the rules read it
    return docs.select("doc_id", sentence_ids(F.col("text"), known).alias("ids")).select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.array_join(names, ",").alias("licenses"), first.alias("license"))
