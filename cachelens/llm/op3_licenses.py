"""License scan by digests of canonical texts.

A text is brought to a canonical form: lower case, spellings of the same word unified, lines of
a copyright holder left out, everything but letters and digits turned to single spaces. Its digest is
looked up in a table of digests of known licences and licence notices, for the whole text and
for each of its lines by itself. The known table is a parameter; ``KNOWN`` is its default. The
join is on 128-bit digests; the table of known texts has a few rows, and the copies that a
very common line makes are counted with its document before the join.

Defined cases: a null or empty text and texts whose canonical form is empty match nothing; null
ids and repeated rows give rows of their own; equal lines of a text give one row with their
number; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence texts and notices as published, by SPDX identifier.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
)
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
"""
BSD_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <%s>"""
#: Whole texts in files, and the line that ends their terms (what follows tells how to apply them).
FILES = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def _titled(name: str, text: str, *titles: str) -> list[tuple[str, str]]:
    return [(name, f"{title}\n\n{text}") for title in ("", *titles)]


def _bsd() -> list[tuple[str, str]]:
    """Clauses with numbers or bullets, holder or owner, with "All rights reserved." or not."""
    out = []
    for n in (2, 3):
        name, titles = f"BSD-{n}-Clause", [f"BSD {n}-Clause License", f"The BSD {n}-Clause License"]
        titles += ["BSD 2-Clause \"Simplified\" License"] if n == 2 else ["BSD 3-Clause \"New\" or \"Revised\" License"]
        for numbered in (True, False):
            conditions = "\n".join(f"{i}. {c}" if numbered else f"* {c}" for i, c in enumerate(BSD_CONDITIONS[:n], 1))
            for end in (BSD_END, BSD_END.replace("HOLDER OR", "OWNER OR")):
                for reserved in ("", "All rights reserved.\n"):
                    out += _titled(name, f"{reserved}{BSD_START}{conditions}\n{end}", *titles)
    return out


def _filed() -> list[tuple[str, str]]:
    out = []
    for name in FILES:
        text = resources.files("cachelens.llm").joinpath(f"licences/{name}.txt").read_text("utf-8")
        terms, end, _ = text.partition(END_OF_TERMS)
        out += [(name, t) for t in ((text, terms + end, terms) if end else (text,))]
    return out


KNOWN = (
    ("MIT", MIT), ("ISC", ISC), *NOTICES,
    *_titled("MIT", MIT.split("\n", 1)[1], "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    *_titled("ISC", ISC.split("\n", 1)[1], "The ISC License", "ISC License (ISC)"),
    *_titled("Zlib", ZLIB, "zlib License", "The zlib License", "zlib/libpng License"),
    *(row for url in ("http://unlicense.org", "http://unlicense.org/", "https://unlicense.org", "https://unlicense.org/") for row in _titled("Unlicense", UNLICENSE % url, "The Unlicense", "Unlicense")),
    *_bsd(), *_filed(),
)
# Spellings that count as the same word.
SPELLINGS = (("licence", "license"), ("sublicence", "sublicense"), ("centre", "center"), ("organisation", "organization"), ("favour", "favor"), ("behaviour", "behavior"),
             ("noncommercial", "non commercial"), ("non-commercial", "non commercial"), ("&", " and "))
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright\b|\(c\)[ \t]*[0-9]|©)[^\n]*$"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    for spelling, same in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(same))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, unit, license_id, n``: matches of the whole text (unit ``text``) and of lines."""
    spark = docs.sparkSession
    names = spark.createDataFrame(list(known), "license_id string, licence string")
    digests = names.select("license_id", F.md5(canonical("licence")).alias("digest")).distinct()
    text = F.col(text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(F.lit("line").alias("unit"), canonical(x).alias("plain")))
    whole = F.array(F.struct(F.lit("text").alias("unit"), canonical(F.col("text")).alias("plain")))
    units = own.select("doc_id", F.explode(F.concat(whole, F.filter(lines, lambda u: u["plain"] != ""))).alias("u")).filter("u.plain <> ''")
    marked = units.select("doc_id", "u.unit", F.md5("u.plain").alias("digest"))
    return marked.join(digests, "digest").groupBy("doc_id", "unit", "license_id").agg(F.count("*").alias("n"))


def oracle(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The same over ``documents`` in DuckDB."""

    def plain(x: str) -> str:
        out = f"regexp_replace(lower(coalesce({x}, '')), '{COPYRIGHT_LINE}', ' ', 'g')"
        for spelling, same in SPELLINGS:
            out = f"replace({out}, '{spelling}', '{same}')"
        return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"

    quoted = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in k)) for k in known)
    return f"""
WITH known AS (SELECT DISTINCT license_id, md5({plain('licence')}) AS digest FROM (VALUES {quoted}) AS t(license_id, licence)),
units AS (
  SELECT doc_id, 'text' AS unit, {plain('text')} AS plain FROM documents
  UNION ALL
  SELECT doc_id, 'line' AS unit, {plain('line')} AS plain
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
)
SELECT doc_id, unit, license_id, count(*) AS n
FROM units JOIN known ON known.digest = md5(units.plain)
WHERE plain <> '' GROUP BY doc_id, unit, license_id"""
