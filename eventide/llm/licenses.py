"""Licence scan by sentence rules (native).

A text is cut into sentences (after a stop and a blank, at a blank line and at
a list mark), sentences are normalised to lower-case words, and each that is
known is replaced by its identifier; the others fall out. A single line break
that a capital, digit or sign follows may end a sentence or stand inside one: a
known sentence begins and ends at a cut or such a break, and the longest that
fits is taken, so that it is found on a line of its own as well as hard-wrapped,
indented or behind comment signs. What remains is the text's sequence of
identifiers. Ordered rules are
matched against it, the most specific first: a rule whose identifiers stand
there one after the other names its licence and takes those identifiers out,
wherever they stand, so that a later, more general rule does not see them
again. Identifiers that no rule takes are reported as ``unmatched``.

Texts without one of the words that every known sentence has a variant of are
not cut. Known sentences and rules are fixed lists, sent as literals; nothing is
shuffled.

Defined cases: a null or empty text has no sentences and no licence; a sentence
that occurs several times gives its identifier each time, a licence is named
once; repeated rows are scanned each; an empty table gives no rows; other
columns pass through, and those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence notices and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-start",
    "you may not use this file except in compliance with the license": "apache2-use",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2-both",
    "you may obtain a copy of the license at": "apache2-copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "spdx license identifier apache 2 0": "spdx-apache2",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "spdx license identifier mit": "spdx-mit",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "spdx license identifier gpl 3 0 only": "spdx-gpl3",
    "spdx license identifier gpl 3 0 or later": "spdx-gpl3-later",
    "licensed under cc by nc 4 0": "cc-by-nc-4-ref",
    "this work is licensed under cc by nc 4 0": "cc-by-nc-4-ref",
    "licensed under cc by 4 0": "cc-by-4-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-start",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all rights reserved": "all-rights",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the copyright owner nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the names of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-warranty",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "see the gnu affero general public license for more details": "agpl-see",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-start",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this is free and unencumbered software released into the public domain": "unlicense-start",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "licensed under cc by sa 4 0": "cc-by-sa-4-ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4-ref",
    "spdx license identifier bsd 2 clause": "spdx-bsd2",
    "spdx license identifier bsd 3 clause": "spdx-bsd3",
    "spdx license identifier gpl 2 0 only": "spdx-gpl2",
    "spdx license identifier gpl 2 0 or later": "spdx-gpl2-later",
    "spdx license identifier lgpl 2 1 or later": "spdx-lgpl21-later",
    "spdx license identifier agpl 3 0 or later": "spdx-agpl3-later",
    "spdx license identifier mpl 2 0": "spdx-mpl2",
    "spdx license identifier isc": "spdx-isc",
    "spdx license identifier unlicense": "spdx-unlicense",
}

# Ordered: a sequence of identifiers, and the licence it shows.
RULES = (
    (("gpl3-later", "gpl-warranty", "gpl-see"), "GPL-3.0-or-later"),
    (("gpl2-later", "gpl-warranty", "gpl-see"), "GPL-2.0-or-later"),
    (("gpl2-only", "gpl-warranty", "gpl-see"), "GPL-2.0-only"),
    (("lgpl21-later", "lgpl-warranty", "lgpl-see"), "LGPL-2.1-or-later"),
    (("lgpl3-later", "gpl-warranty", "lgpl-see"), "LGPL-3.0-or-later"),
    (("agpl3-later", "gpl-warranty", "agpl-see"), "AGPL-3.0-or-later"),
    (("gpl3-later",), "GPL-3.0-or-later"),
    (("gpl2-later",), "GPL-2.0-or-later"),
    (("gpl2-only",), "GPL-2.0-only"),
    (("lgpl21-later",), "LGPL-2.1-or-later"),
    (("lgpl3-later",), "LGPL-3.0-or-later"),
    (("agpl3-later",), "AGPL-3.0-or-later"),
    (("apache2-start", "apache2-use", "apache2-copy", "apache2-basis", "apache2-see"), "Apache-2.0"),
    (("apache2-both", "apache2-copy", "apache2-basis", "apache2-see"), "Apache-2.0"),
    (("apache2-start", "apache2-use", "apache2-copy"), "Apache-2.0"),
    (("apache2-both", "apache2-copy"), "Apache-2.0"),
    (("apache2-both",), "Apache-2.0"),
    (("mit-grant", "mit-notice", "mit-warranty", "mit-liability"), "MIT"),
    (("mit-grant", "mit-notice", "mit-warranty"), "MIT"),
    (("mit-notice", "mit-warranty"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("bsd-start", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability"), "BSD-3-Clause"),
    (("bsd-start", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-start", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability"), "BSD-2-Clause"),
    (("bsd-start", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("mpl2-start", "mpl2-copy"), "MPL-2.0"),
    (("isc-grant", "isc-warranty"), "ISC"),
    (("isc-grant",), "ISC"),
    (("unlicense-start", "unlicense-free"), "Unlicense"),
    (("unlicense-start",), "Unlicense"),
    (("spdx-apache2",), "Apache-2.0"),
    (("spdx-mit",), "MIT"),
    (("spdx-gpl3-later",), "GPL-3.0-or-later"),
    (("spdx-gpl3",), "GPL-3.0-only"),
    (("spdx-bsd2",), "BSD-2-Clause"),
    (("spdx-bsd3",), "BSD-3-Clause"),
    (("spdx-gpl2",), "GPL-2.0-only"),
    (("spdx-gpl2-later",), "GPL-2.0-or-later"),
    (("spdx-lgpl21-later",), "LGPL-2.1-or-later"),
    (("spdx-agpl3-later",), "AGPL-3.0-or-later"),
    (("spdx-mpl2",), "MPL-2.0"),
    (("spdx-isc",), "ISC"),
    (("spdx-unlicense",), "Unlicense"),
    (("apache2-ref",), "Apache-2.0"),
    (("mit-ref",), "MIT"),
    (("gpl3-ref",), "GPL-3.0"),
    (("cc-by-nc-4-ref",), "CC-BY-NC-4.0"),
    (("cc-by-sa-4-ref",), "CC-BY-SA-4.0"),
    (("cc-by-4-ref",), "CC-BY-4.0"),
    (("all-rights",), "Proprietary"),
)
# Said by notices of free licences too: named only where no other rule has found a licence.
LAST = ("Proprietary",)

# Every known sentence has one of these.
SIGNS = ("licens", "redistribut", "warranty", "warranties", "permission", "reserved", "liab", "public domain", "anyone is free", "copy of the mpl")

# Marks of a cut, of a line break that may be one, and of a blank line.
CUT, BREAK, BLANK_LINE = "\u0001", "\u0002", "\u0003"


def _coded(ids: tuple[str, ...]) -> str:
    """A sequence as text in which each identifier has its own borders."""
    return "".join(f"<{i}>" for i in ids)


def marked(text: Column) -> Column:
    """The words of a text in lower case, joined by a blank, CUT or BREAK, with
    CUT at both ends."""
    t = F.translate(text, BREAK + BLANK_LINE, "  ")
    t = F.regexp_replace(t, "(?:^|\\n)[ \\t]*+(?:dnl|REM)\\b", "\n#")  # comment signs made of letters
    t = F.regexp_replace(t, "\\n[^A-Za-z0-9(\\n]*+(?:[(]?(?:[0-9]{1,2}|[A-Za-z])[)]|[a-z][.])[ \\t]+", CUT)
    t = F.regexp_replace(t, "([.!?])[ \\t\\r\\n]+", f"$1{CUT}")
    t = F.regexp_replace(t, "\\n[ \\t\\r]*+\\n[ \\t\\r\\n]*+", BLANK_LINE)
    t = F.regexp_replace(t, f"{BLANK_LINE}([^a-z])", f"{CUT}$1")
    t = F.regexp_replace(t, f"{BLANK_LINE}|\\n[ \\t\\r]*+(?=[^a-z \\t\\r\\n])", BREAK)
    t = F.regexp_replace(F.concat(F.lit(CUT), F.lower(t), F.lit(CUT)), f"[^a-z0-9{CUT}{BREAK}]+", " ")
    t = F.regexp_replace(t, f" ?{BREAK}[ {BREAK}]*+", BREAK)
    return F.regexp_replace(t, f"[ {BREAK}]?{CUT}[ {CUT}{BREAK}]*+", CUT)


def known_sentences(text: Column) -> Column:
    """The known sentences of a text, in order."""
    longest_first = sorted(SENTENCES, key=lambda s: (-len(s), s))
    one = "|".join(s.replace(" ", f"[ {BREAK}]") for s in longest_first)
    found = F.regexp_extract_all(marked(text), F.lit(f"(?<=[{CUT}{BREAK}])(?:{one})(?=[{CUT}{BREAK}])"), F.lit(0))
    return F.transform(found, lambda s: F.replace(s, F.lit(BREAK), F.lit(" ")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents' columns with n_known (known sentences), identifiers (in
    order, space-joined), licenses (sorted, comma-joined) and unmatched
    (identifiers no rule took, in order)."""
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    signed = F.lower(body).rlike("|".join(SIGNS))
    ids = F.when(signed, F.transform(known_sentences(body), lambda s: known[s]))
    ids = F.coalesce(ids, F.array().cast("array<string>"))
    rules = F.array(*[F.struct(F.lit(_coded(seq)).alias("seq"), F.lit(name).alias("name"), F.lit(name in LAST).alias("last"))
                      for seq, name in RULES])
    start = F.transform(F.array(ids), lambda x: F.struct(
        F.array_join(F.transform(x, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("rest"),
        F.array().cast("array<string>").alias("found"), x.alias("ids")))[0]

    def apply(state: Column, rule: Column) -> Column:
        held = F.contains(state["rest"], rule["seq"]) & (~rule["last"] | (F.size(state["found"]) == 0))
        return F.when(held, F.struct(
            F.replace(state["rest"], rule["seq"], F.lit("|")).alias("rest"),
            F.array_union(state["found"], F.array(rule["name"])).alias("found"), state["ids"].alias("ids"))
        ).otherwise(state)

    done = F.transform(F.array(start), lambda s: F.when(F.size(s["ids"]) > 0, F.aggregate(rules, s, apply)).otherwise(s))[0]
    new = ("n_known", "identifiers", "licenses", "unmatched")
    others = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in new]
    got = docs.select(*others, done.alias("_scan"))
    left = F.regexp_replace(F.regexp_replace("_scan.rest", "[|]", ""), "><", " ")
    return got.select(*[got[f"`{c}`"] for c in got.columns[:-1]],
                      F.size("_scan.ids").cast("long").alias("n_known"), F.array_join("_scan.ids", " ").alias("identifiers"),
                      F.array_join(F.array_sort("_scan.found"), ",").alias("licenses"),
                      F.regexp_replace(left, "[<>]", "").alias("unmatched"))
