"""Licence scan by sentence rules.

Text is cut into sentences, each normalised to lower-case words, and looked up in the table of known
licence sentences. A document's known sentences, in order, form a sequence of identifiers; a licence
rule is an ordered sequence too, and it is found where its identifiers follow each other in the
document with no other known sentence between them (unknown text may stand between).

Besides the table's one-sentence forms, the sentences of the standard texts count as the operator itself
cuts them: STANDARD holds the texts, and `spellings` passes them through the same cut and normalisation.

Defined cases: null or empty text has no licence; repeated rows get equal results; a sentence met
twice counts twice, a rule found twice is reported once with its count; an empty table gives an empty
result; only doc_id and text are read, so that other columns cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised, by identifier. Fixed values.
SENTENCES = {
    "apache2-ref": "licensed under the apache license version 2 0",
    "apache2-you-may-not": "you may not use this file except in compliance with the license",
    "apache2-obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mit-ref": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc4-ref": "licensed under cc by nc 4 0",
    "cc-by4-ref": "licensed under cc by 4 0",
    "cc0-ref": "this work is dedicated to the public domain under cc0 1 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-disclaim": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}

#: Licence rules: ordered identifiers. Fixed values.
RULES = {
    "apache-2.0-reference": ("Apache-2.0", ["apache2-ref"]),
    "apache-2.0-header": ("Apache-2.0", ["apache2-ref", "apache2-you-may-not", "apache2-obtain", "apache2-as-is"]),
    "gpl-3.0-reference": ("GPL-3.0", ["gpl3-ref"]),
    "gpl-3.0-notice": ("GPL-3.0", ["gpl-free", "gpl-hope"]),
    "mit-reference": ("MIT", ["mit-ref"]),
    "mit-text": ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    "bsd-2-clause-text": ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    "bsd-3-clause-text": ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    "cc-by-nc-4.0-reference": ("CC-BY-NC-4.0", ["cc-by-nc4-ref"]),
    "cc-by-4.0-reference": ("CC-BY-4.0", ["cc-by4-ref"]),
    "cc0-1.0-reference": ("CC0-1.0", ["cc0-ref"]),
    "isc-text": ("ISC", ["isc-grant", "isc-disclaim"]),
    "unlicense-text": ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    "zlib-text": ("Zlib", ["zlib-as-is", "zlib-grant"]),
    "mpl-2.0-notice": ("MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    "lgpl-2.1-notice": ("LGPL-2.1", ["lgpl-free", "lgpl-terms", "lgpl-version"]),
    "agpl-3.0-notice": ("AGPL-3.0", ["gpl-free-software", "agpl-terms"]),
}

#: Standard texts by rule, and the identifiers of what they are cut into, in order; None: not part of the rule.
STANDARD = {
    "apache-2.0-header": (
        """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
        ["apache2-ref", "apache2-you-may-not", "apache2-obtain-at", "apache2-url", "apache2-as-is", None],
    ),
    "gpl-3.0-notice": (
        """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
""",
        ["gpl-free-software", "gpl-free-terms", "gpl-hope-useful", "gpl-hope-implied", None],
    ),
    "mpl-2.0-notice": (
        """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
""",
        ["mpl2-form", None, "mpl2-copy"],
    ),
    "lgpl-2.1-notice": (
        """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
""",
        ["lgpl-free", "lgpl-terms", "lgpl-version"],
    ),
    "agpl-3.0-notice": (
        """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.
""",
        ["gpl-free-software", "agpl-terms"],
    ),
    "mit-text": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
""",
        ["mit-grant", "mit-notice", "mit-as-is", None],
    ),
    "bsd-3-clause-text": (
        """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
        ["bsd-redistribution", None, "bsd-source", None, "bsd-binary", None, "bsd-endorse"],
    ),
}

#: A sentence ends at a line break or at a mark followed by white space; licence texts are often
#: wrapped, so a single line break inside a sentence is handled by looking at both cuts.
LINE = "\n"
PARAGRAPH = r"\n[\x20\x09-\x0D]*\n"
STOP = r"[.!?;:]+[\x20\x09-\x0D]+"
CUT = PARAGRAPH + "|" + STOP


def _normal(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " "))


def spellings(standard: dict = STANDARD) -> dict[str, str]:
    """Identifiers by the sentences of the standard texts, cut and normalised as `scan` does."""
    found = {}
    for text, ids in standard.values():
        cut = [re.sub(r"[^a-z0-9]+", " ", x.lower()).strip(" ") for x in re.split(CUT, text)]
        found |= {x: k for x, k in zip(filter(None, cut), ids, strict=True) if k}
    return found


def table_of(sentences: dict = SENTENCES, standard: dict = STANDARD) -> dict[str, str]:
    """Identifiers by normalised sentence."""
    return {v: k for k, v in sentences.items()} | spellings(standard)


def hint(known: list[str]) -> str:
    """Words one of which each known sentence has: a text without them, in lower case, has no known sentence."""
    left, words = [set(s.split()) for s in known], []
    while left:
        count: dict[str, int] = {}
        for s in left:
            for w in s:
                count[w] = count.get(w, 0) + 1
        # rare words tell more: of those that many sentences share, the longest
        best = max(count, key=lambda w: (min(count[w], 4), len(w), w))
        words.append(best)
        left = [s for s in left if best not in s]
    return "|".join(sorted(words))


def patterns(rules: dict = RULES, standard: dict = STANDARD) -> dict[str, str]:
    """By rule, the expression that its sequence, or its standard text's, matches among identifiers between bars."""
    found = {}
    for name, (_, ids) in rules.items():
        forms = {"".join(f"|{i}|" for i in form if i) for form in (ids, standard.get(name, ("", ids))[1])}
        found[name] = "|".join(re.escape(x) for x in sorted(forms, key=len, reverse=True))
    return found


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: dict = SENTENCES, rules: dict = RULES, standard: dict = STANDARD) -> DataFrame:
    """(doc_id, sentence_ids, rules, licenses, n_matches) for documents in which a rule is found."""
    names = table_of(sentences, standard)
    known = list(names)
    d = docs.filter(F.lower(F.col(text)).rlike(hint(known))).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))

    # one line break is a blank within wrapped text; what is no known sentence so is looked up line by line, in its place
    def places(x: Column) -> Column:
        lines = F.filter(F.transform(F.split(x, LINE), _normal), lambda s: s.isin(known))
        return F.when(_normal(x).isin(known), F.array(_normal(x))).when(x.contains(LINE), lines).otherwise(F.array().cast("array<string>"))

    d = d.select("doc_id", F.flatten(F.transform(F.split("t", CUT), places)).alias("found")).filter(F.size("found") > 0)
    to_id = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    d = d.select("doc_id", F.transform("found", lambda s: to_id[s]).alias("sentence_ids"))
    # identifiers between bars: a rule matches where its own sequence, or its standard text's, stands in the document's
    seq = F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|"))
    d = d.withColumn("seq", seq)
    hits = []
    for name, pattern in patterns(rules, standard).items():
        n = F.regexp_count("seq", F.lit(pattern)).cast("long")
        hits.append(F.struct(F.lit(name).alias("rule"), F.lit(rules[name][0]).alias("license"), n.alias("n")))
    d = d.withColumn("hits", F.filter(F.array(*hits), lambda h: h.n > 0)).filter(F.size("hits") > 0)
    return d.select(
        "doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join(F.sort_array(F.transform("hits", lambda h: h["rule"])), ",").alias("rules"),
        F.array_join(F.sort_array(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",").alias("licenses"),
        F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["n"]).alias("n_matches"),
    )
