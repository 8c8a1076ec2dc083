"""Licence scan by canonical digests: texts that say the same licence in another dress have the same digest."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascreen.llm.shared import written

#: Spellings that licence comparison treats as equal.
SPELLINGS = {
    "licence": "license", "sub license": "sublicense", "non commercial": "noncommercial", "organisation": "organization", "whilst": "while",
    "acknowledgement": "acknowledgment", "authorisation": "authorization", "authorised": "authorized", "recognised": "recognized",
    "favour": "favor", "fulfil ": "fulfill ", "copyright owner": "copyright holder", "per cent": "percent", "https": "http",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Public licence texts and notices.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC + "\n\n" + _ISC_END),
    ("ISC", "ISC License\n\n" + _ISC + "\n\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); " + _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
]


def canonical(text: Column) -> Column:
    """Lines of words: lower case, no copyright lines, one space for each stretch of other signs, one spelling."""
    plain = F.regexp_replace(F.lower(text), r"(^|\n)[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*", "$1")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}\n]+", " ")
    for old, new in SPELLINGS.items():
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return plain


def lines(canon: Column) -> Column:
    return F.filter(F.transform(F.split(canon, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def digest(words: Column) -> Column:
    return F.sha2(words.cast("binary"), 256)


def known_licenses(spark: SparkSession, texts: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """``digest, license`` of known texts, canonical like any other; the first name wins where two texts have one digest."""
    table = spark.createDataFrame([(name, text, i) for i, (name, text) in enumerate(texts)], "license string, text string, i int")
    coded = table.select("license", "i", digest(F.array_join(lines(canonical(F.col("text"))), " ")).alias("digest"))
    return coded.groupBy("digest").agg(F.min_by("license", "i").alias("license"))


def scan(docs: DataFrame, known: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``digest`` of the entire canonical text, ``license`` (that of the entire text, or null) and ``notices``.

    ``notices`` holds the licences whose entire text is one line of the document, sorted and comma-joined, empty without any. Texts meet
    ``known`` by a join on the digest, lines by the same join after equal ones have been put together. A null text counts as empty;
    the empty text has no licence. Repeated rows each have a row.
    """
    source = docs.select(F.struct(*[docs[c] for c in keep]).alias("kept"), canonical(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("canon"))
    cut = source.select("kept", lines(F.col("canon")).alias("lines"))
    coded = cut.select("kept", F.monotonically_increasing_id().alias("at"), digest(F.array_join("lines", " ")).alias("digest"),
                       F.array_distinct(F.transform("lines", digest)).alias("parts"))
    coded = written(coded, "license-digests")
    noticed = (coded.select("at", F.explode("parts").alias("digest")).join(known, "digest")
               .groupBy("at").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices")))
    result = coded.select("kept", "at", "digest").join(known, "digest", "left").join(noticed, "at", "left")
    own = ("digest", "license", "notices")
    return result.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep if c not in own], "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))
