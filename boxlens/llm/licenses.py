"""License scan by canonical digests (operator 1), in DataFrame functions only.

Whole texts are brought to a canonical form and hash-joined to the digests of known
license texts and notices. The texts are each document as a whole and each of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlens.session import materialize

#: Known texts by license, as their owners publish them (notices and short licenses).
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
            "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
            "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
            "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
            "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
            "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
            "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

#: Spellings that count as equal (left becomes right), as whole words after folding.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("behaviour", "behavior"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("copyright holder", "copyright owner"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"),
)

COPYRIGHT_LINE = r"(?m)^[^\S\n]*(?:copyright[^\S\n]*(?:\(c\)|©|[0-9]{4})|\(c\)[^\S\n]*[0-9]{4}|©)[^\n]*$"
#: ASCII that is neither digit nor letter, and typographic quotes, dashes, dots and the fixed blank
APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F“”„‘’‚«»–—―…•·\u00a0]+"


def fold(text: Column) -> Column:
    """Lower case, no copyright lines, every run of punctuation and blanks one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " "), APART, " "))


def respell(text: Column) -> Column:
    """Equivalent spellings of a folded text become one; doubled blanks let each rule match whole words."""
    text = F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.replace(text, F.lit("  "), F.lit(" ")))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(digest, license, first word) of the known texts, one row per digest; texts that fold to nothing are left out."""
    rows = spark.createDataFrame(list(known), "license string, text string").withColumn("folded", fold(F.col("text"))).filter("folded <> ''")
    canonical = rows.withColumn("canonical", respell(F.col("folded")))
    return canonical.groupBy(F.sha2("canonical", 256).alias("digest")).agg(
        F.min("license").alias("license"), F.min(F.substring_index("canonical", " ", 1)).alias("word"))


def _openings(words: list[str]) -> list[str]:
    """Folded words that a text can begin with whose canonical form begins with one of ``words``."""
    return sorted({*words, *(old.split()[0] for old, new in SPELLINGS if new.split()[0] in words)})


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, license (of the whole text, null if none), n_notices (lines that are a known text), notices (their licenses).

    Only texts that begin like a known one are respelled and hashed. The known digests are
    broadcast: they are a fixed list, whatever the size of the table. Null and empty texts
    match nothing. If several licenses have one canonical text, the least name counts.
    Repeated rows come back once per occurrence, an empty table gives an empty result,
    other columns are not read.
    """
    digests = materialize(known_digests(docs.sparkSession, known), "licenses")
    openings = _openings([r.word for r in digests.select("word").distinct().collect()])

    def digest(text: Column) -> Column:
        begins = lambda t: F.substring_index(t, " ", 1).isin(openings)
        return F.get(F.transform(F.array(fold(text)), lambda t: F.when(begins(t), F.sha2(respell(t), 256))), 0)

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    units = F.concat(F.array(text), F.split(text, "\n"))
    found = F.filter(F.transform(units, lambda t, i: F.struct((i == 0).alias("whole"), digest(t).alias("digest"))), lambda x: x["digest"].isNotNull())
    # the row number is written with the rows, so it stays the same however often they are read
    rows = materialize(docs.select(docs[id_col].alias("id"), found.alias("units")).withColumn("row", F.monotonically_increasing_id()), "license-units")
    matched = rows.select("row", "id", F.explode_outer("units").alias("unit")).select("row", "id", "unit.*").join(F.broadcast(digests), "digest", "left")
    line = F.when(~F.col("whole"), F.col("license"))
    return matched.groupBy("row").agg(
        F.first("id").alias("id"), F.max(F.when(F.col("whole"), F.col("license"))).alias("license"), F.count(line).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(line)), ",").alias("notices")).drop("row")
