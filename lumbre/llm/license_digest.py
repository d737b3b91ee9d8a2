"""License scan by canonical digest lookup. DataFrame operations only.

A text is brought to a canonical form and its SHA-256 looked up among the digests of known licenses: a whole document
that is a license matches whatever its case, punctuation, copyright holders or spelling variants; a document that only
quotes one does not. The corpus is scanned once and nothing of it is shuffled while the known digests are few (checked).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.llm import _shared as S

# Equivalent spellings, variant and canonical form, as in the SPDX matching guidelines.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "wilfull"),
)

# Texts of public licenses. A caller may pass a table of its own (license_id, text).
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
LICENSES = (
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"),
    ("Apache-2.0-notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_WARRANTY),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("MIT", f"MIT License\n\n{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_MIT_WARRANTY}"),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    # Single-line notices, as files often carry them alone.
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0"),
    ("MIT-line", "Released under the MIT License"),
    ("GPL-3.0-line", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
)

# Licence text that a line break may put at the start of a line, unlike the holder or year of a copyright statement.
_BODY = r"(notices?|holders?|owners?|laws?|licen[cs]es?|interests?|statements?|disclaimers?|and|or|in|is)"

# The canonical form, as (pattern, replacement) in the common subset of Java's and RE2's syntax but for the first's lookahead. Letters are lower case by then.
STEPS = (
    (r"(^|\n)[^\na-z0-9]*(copyright(?![^a-z0-9(©]*" + _BODY + r"\b)|\(c\)|©)[^\n]*", "\n"),  # copyright statements
    (r"(^|\n)[^\na-z0-9]*all rights reserved[^\n]*", "\n"),
    (r"https?://", ""),
    (r"[^a-z0-9\x80-\x{10FFFF}]+", " "),  # punctuation, comment marks and white space
)
# RE2 has no lookahead: in the SQL, every line that begins with the word goes. The two differ on texts that wrap there.
SQL_STEPS = ((r"(^|\n)[^\na-z0-9]*(copyright|\(c\)|©)[^\n]*", "\n"), *STEPS[1:])


def canonical(text):
    """Lower case (A-Z), no copyright lines, no punctuation; each word between two blanks of its own, which the spelling step uses as word limits."""
    col = S.ascii_lower(F.coalesce(text, F.lit("")))
    for pattern, to in STEPS:
        col = F.regexp_replace(col, pattern, to)
    return F.concat(F.lit(" "), F.replace(F.trim(col), F.lit(" "), F.lit("  ")), F.lit(" "))


def _one_spelling(col):
    """One spelling, words by one space. Neighbours share no blank, so a variant that is repeated is met each time."""
    for variant, to in SPELLINGS:
        col = F.replace(col, F.lit(f" {variant} "), F.lit(f" {to} "))
    return F.trim(F.replace(col, F.lit("  "), F.lit(" ")))


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LICENSES), "license_id string, text string")


def digests(texts: DataFrame, text_col: str):
    return F.sha2(_one_spelling(canonical(F.col(text_col))), 256)


def license_scan(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, canonical_sha256, license_id (null: no known license is this text).

    Null texts count as empty and match nothing, as do texts whose canonical form is empty. Of several licenses with
    one canonical form the least id is named. Repeated rows are each returned, null ids carried, extra columns ignored.
    """
    licenses = known_licenses(docs.sparkSession) if licenses is None else licenses
    known = licenses.select(digests(licenses, "text").alias("digest"), "license_id").filter(F.col("digest") != F.sha2(F.lit(""), 256))
    known = S.store(known.groupBy("digest").agg(F.min("license_id").alias("license_id")), "licenses")
    few = S.within_bound(known)
    rows = docs.select(F.col(id_col).alias("doc_id"), digests(docs, text_col).alias("canonical_sha256"))
    out = rows.join(F.broadcast(known) if few else known, rows["canonical_sha256"] == known["digest"], "left")
    return out.select("doc_id", "canonical_sha256", "license_id")


def oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(text: str) -> str:
        col = f"translate(coalesce({text}, ''), '{S.UPPER}', '{S.LOWER}')"
        for pattern, to in SQL_STEPS:
            col = f"regexp_replace({col}, {quote(pattern)}, " + ("chr(10)" if to == "\n" else quote(to)) + ", 'g')"
        col = f"' ' || replace(trim({col}, ' '), ' ', '  ') || ' '"
        for variant, to in SPELLINGS:
            col = f"replace({col}, ' {variant} ', ' {to} ')"
        return f"sha256(trim(replace({col}, '  ', ' '), ' '))"

    rows = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in LICENSES)
    return f"""
WITH known AS (
  SELECT {form("text")} AS digest, min(license_id) AS license_id FROM (VALUES {rows}) v(license_id, text) GROUP BY 1
), d AS (
  SELECT doc_id, {form("text")} AS canonical_sha256 FROM documents
)
SELECT doc_id, canonical_sha256, license_id FROM d LEFT JOIN known ON digest = canonical_sha256 AND digest <> sha256('')
"""
