"""License recognition by sentences and rules.

A text is cut into sentences, twice: once with line ends as sentence ends, for
notices on lines of their own, and once with line ends as spaces, for wrapped
paragraphs, in comments too; there, lines that state a copyright and lines
without a letter or digit end a paragraph. Sentences are normalised (lower case,
anything but letters and digits one space) and looked up among known licence
sentences; the identifiers found, in order, are matched against the rules, each
an ordered list of identifiers that may have others between them. The
sentences and rules below are defaults; both can be given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import table

# Normalised sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "agpl-version": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-notice": "released under the bsd license",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0-notice": "licensed under cc0 1 0",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl2-version": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only-version": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-version": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl21-version": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-version": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3-notice": "this work is licensed under the gnu lesser general public license version 3",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-notice": "released under the mit license",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-copy-http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-source": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-source-v": "this source code form is subject to the terms of the mozilla public license v",
}
# Rules, each a licence and the sentences that state it, in order.
RULES = (
    ("AGPL-3.0-or-later", ("agpl-version",)),
    ("Apache-2.0", ("apache-header", "apache-asis", "apache-see")),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-notice",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD", ("bsd-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("GPL-2.0-only", ("gpl2-only-version",)),
    ("GPL-2.0-or-later", ("gpl2-version",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl3-version",)),
    ("ISC", ("isc-grant",)),
    ("LGPL-2.1-or-later", ("lgpl21-version",)),
    ("LGPL-3.0-or-later", ("lgpl3-version",)),
    ("LGPL-3.0-only", ("lgpl3-notice",)),
    ("MIT", ("mit-grant", "mit-keep", "mit-warranty")),
    ("MIT", ("mit-notice",)),
    ("MPL-2.0", ("mpl-source",)),
    ("MPL-2.0", ("mpl-source-v", "mpl-copy")),
    ("MPL-2.0", ("mpl-source-v", "mpl-copy-http")),
)
#: A longer rule says more than one whose licence it names here.
INSTEAD = {"BSD-3-Clause": "BSD-2-Clause"}
#: Parts of words of which every licence sentence above has one.
HINTS = ("licen", "permi", "redistribut", "warrant", "mpl")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINES, _PARAGRAPHS = r"[.!?]+[\t ]+|\n", r"[.!?]+[\t-\r ]+|\n[^a-z0-9\n]*\n"
# Words of sentences, which a line may begin with, and lines that state a copyright; in these the word stands alone.
_MENTION, _COPYRIGHT = r"copyright([^a-z0-9]+)(notice|holder)", r"(?m)^[^a-z0-9\n]*(copyright([^a-z0-9_\n][^\n]*)?|spdx[^\n]*)$"


def _identifiers(text: Column, ends: str, sentences: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for i, s in sentences.items() for x in (s, i)])
    ids = F.transform(F.split(text, ends), lambda s: known[F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))])
    return F.filter(ids, lambda i: i.isNotNull())


def hints(sentences: dict[str, str]) -> list[str]:
    """Parts of words of which every given sentence has one.

    A text in which none is has none of the sentences: line ends and comment marks
    part words, but are never inside one.
    """
    out = [h for h in HINTS if any(h in s for s in sentences.values())]
    for s in sentences.values():
        if not any(h in s for h in out):
            out.append(max(s.split(), key=len, default=""))
    return out


def _rule(ids: tuple[str, ...]) -> str:
    return "(^| )" + "( .*)? ".join(ids) + "( |$)"


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES, instead: dict[str, str] = INSTEAD) -> DataFrame:
    """(doc_id, n_sentences, sentences, licenses) for every row of ``docs``.

    ``sentences`` are normalised ones by identifiers without spaces, ``rules``
    (name, identifiers in order), and ``instead`` names for a rule the weaker one
    that it replaces. Without sentences or rules nothing is found.

    ``sentences`` are the identifiers of the cut that finds more (of equal ones
    the one by paragraphs, whose sentences are longer), ``licenses`` the names of the rules that match either
    cut, sorted; both joined by spaces. Null and empty texts have none.
    Texts of any length are read as wholes. Repeated rows get equal results, null
    ids stay null, further columns are ignored, no rows give no rows.
    """
    text = F.translate(F.col(text_col), _UPPER, _LOWER)
    none = F.array().cast("array<string>")
    if not sentences or not rules:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("n_sentences"), F.lit("").alias("sentences"), F.lit("").alias("licenses"))
    hinted = text.rlike("|".join(hints(sentences)))
    stated = F.regexp_replace(F.regexp_replace(text, _MENTION, "copyright_$1$2"), _COPYRIGHT, "\n\n")
    by_line, by_paragraph = _identifiers(text, _LINES, sentences), _identifiers(stated, _PARAGRAPHS, sentences)
    d = docs.select(F.col(id_col).alias("doc_id"), *[F.when(hinted, x).otherwise(none).alias(n) for x, n in ((by_line, "a"), (by_paragraph, "b"))])
    d = d.select("doc_id", F.when(F.size("b") >= F.size("a"), F.col("b")).otherwise(F.col("a")).alias("s"), F.array_join("a", " ").alias("a"), F.array_join("b", " ").alias("b"))
    found = {}
    for name, ids in rules:
        met = F.col("a").rlike(_rule(ids)) | F.col("b").rlike(_rule(ids))
        found[name] = found[name] | met if name in found else met
    for name, weaker in ((n, w) for n, w in instead.items() if n in found and w in found):
        found[weaker] = found[weaker] & ~found[name]
    names = F.array_compact(F.array(*[F.when(met, F.lit(name)) for name, met in sorted(found.items())]))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_join("s", " ").alias("sentences"), F.when((F.col("a") == "") & (F.col("b") == ""), "").otherwise(F.array_join(names, " ")).alias("licenses"))


def op3_license_sentences(spark, sf_dir):
    return licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    known = "MAP {" + ", ".join(f"'{s}': '{i}'" for i, s in SENTENCES.items()) + "}"
    ids = "list_filter(list_transform(regexp_split_to_array({}, '{}'), lambda s: m[trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))]), lambda i: i IS NOT NULL)"
    met: dict[str, list[str]] = {}
    for name, rule in RULES:
        met.setdefault(name, []).extend(f"regexp_matches({c}, '{_rule(rule)}')" for c in "ab")
    both = {n: "(" + " OR ".join(x) + ")" for n, x in met.items()}
    for name, weaker in INSTEAD.items():
        both[weaker] = f"({both[weaker]} AND NOT {both[name]})"
    names = ", ".join(f"CASE WHEN {x} THEN '{n}' END" for n, x in sorted(both.items()))
    own = f"regexp_replace(regexp_replace(t, '{_MENTION}', 'copyright_\\1\\2', 'g'), '{_COPYRIGHT}', chr(10) || chr(10), 'g')"
    return f"""
WITH known AS (SELECT {known} AS m),
d AS (SELECT doc_id, translate(text, '{_UPPER}', '{_LOWER}') AS t FROM documents),
l AS (SELECT doc_id, coalesce({ids.format("t", _LINES)}, []) AS a, coalesce({ids.format(own, _PARAGRAPHS)}, []) AS b FROM d, known),
j AS (SELECT doc_id, CASE WHEN len(b) >= len(a) THEN b ELSE a END AS s, array_to_string(a, ' ') AS a, array_to_string(b, ' ') AS b FROM l)
SELECT doc_id, len(s)::BIGINT AS n_sentences, array_to_string(s, ' ') AS sentences, array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ' ') AS licenses
FROM j"""


ORACLE = _oracle()
