"""Operator 10, licence scans by canonical digest lookup.

Texts that are licences differ in case, punctuation, copyright lines and spelling. All of that is normalised, the
whole canonical text is digested, and the digest is joined to the digests of known licences. Three kinds of unit are
looked up as entire texts: the document, its blocks between blank lines, and its single lines (short notices).

Only DataFrame functions. Null and empty texts match nothing; a very long text is normalised whole; repeated rows get
the same answer, each its own row; an empty table gives an empty result; other columns are not read. The table of
known licences has a fixed size, so it may be broadcast.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

# Pairs of spellings that count as equal, the second standing for both, applied to whole words in order.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorised", "authorized"), ("organisation", "organization"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("judgement", "judgment"), ("merchantibility", "merchantability"), ("noncommercial", "non commercial"),
    ("non infringement", "noninfringement"), ("per cent", "percent"), ("programme", "program"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("v2 0", "version 2 0"), ("v3", "version 3"), ("https", "http"),
)

# Texts of known licences and notices. A line of equal signs is not part of any.
_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
_WARRANTY_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = (
    ("MIT", "MIT License\n\nCopyright (c) holder\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY_MIT),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY_MIT),
    ("BSD-2-Clause", _BSD_HEAD + _WARRANTY_BSD),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _WARRANTY_BSD),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _WARRANTY_ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _WARRANTY_ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
)

# Digests of the canonical forms of whole licences (the texts of Debian's common-licenses): with all that follows
# the terms ("whole"), up to the line that ends the terms ("terms"), and without that line ("before end").
KNOWN_DIGESTS = (
    ("Apache-2.0", "whole", "0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9"),
    ("Apache-2.0", "terms", "0933e9fdf25f8a4aced10e10246650350123e13b939182f69b5ec6730ce2d793"),
    ("Apache-2.0", "before end", "a657010cc8660623635462386107381af70d2c7ec43ab36e27484c72cbb3b28f"),
    ("Artistic-1.0-Perl", "whole", "7684e7ab2b843b2ea93db77f1db7f373c6a2c3be0cb5c87cb97f1c1752ab1cf4"),
    ("CC0-1.0", "whole", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "whole", "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f"),
    ("GFDL-1.3", "whole", "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4"),
    ("GPL-1.0", "whole", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-1.0", "terms", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),
    ("GPL-1.0", "before end", "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb"),
    ("GPL-2.0", "whole", "c230c00f329737cb7ce3d97a266318b4c9d4c1fd321335e592b2ce1112179b88"),
    ("GPL-2.0", "terms", "ae49934a47b15ec36e1ce1eb7504b3439c29f0e9be2ed0f60ba20ad7124dcb7c"),
    ("GPL-2.0", "before end", "178d586a448701f01712744f9de166175b5625d05f71dd532a3d694e2b935def"),
    ("GPL-3.0", "whole", "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f"),
    ("GPL-3.0", "terms", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b"),
    ("GPL-3.0", "before end", "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943"),
    ("LGPL-2.0", "whole", "e2c319279ddf282349927826fd110bdb5b471edc3a726a66fe333c8184a4b135"),
    ("LGPL-2.0", "terms", "a07313094d4e63b099417491ebc80c933bf85c36d5afddbf13be9a11457c8513"),
    ("LGPL-2.0", "before end", "a745f6517e6dd821b7e0352067dcf8f32789a02694b661bfad965280370e9b1a"),
    ("LGPL-2.1", "whole", "13cd11e9ccd3aae212d64d9b0f62b3a67f21019c6a65212e582b2cbbeb91cb70"),
    ("LGPL-2.1", "terms", "bfe8e5dc6cef43d0c4777d9c1891f596159cda682ef40545ad2105f66b9746f1"),
    ("LGPL-2.1", "before end", "4656c6936fdab5334aa4c4800c6a7881ffce24f3abb1f578c24da0bbb2735d0a"),
    ("LGPL-3.0", "whole", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "whole", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "whole", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)

#: A line that only says who holds the copyright. Java and RE2 read it alike.
COPYRIGHT_LINE = r"(?m)^[ \t/*#;-]*(copyright|\(c\)|©|all rights reserved)([^a-z\n][^\n]*)?$"
#: What is not a letter or digit; anything beyond ASCII counts as one.
MARKS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Every known canonical text holds one of these, and no normalisation makes one where there was none.
ANCHOR = r"licen[cs]|permission|redistribution|public domain"


def canonical(unit: Column) -> Column:
    """The canonical form of a text that is lower-cased already."""
    plain = F.regexp_replace(F.regexp_replace(unit, COPYRIGHT_LINE, ""), MARKS, " ")
    plain = F.concat(F.lit(" "), F.trim(plain), F.lit(" "))
    for one, other in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.trim(plain)


def canonical_text(text: str) -> str:
    """The same in Python, for the table of known licences."""
    text = text.translate({c: c + 32 for c in range(65, 91)})
    text = re.sub(COPYRIGHT_LINE.replace("(?m)", ""), "", text, flags=re.M)
    text = " " + re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", text).strip(" ") + " "
    for one, other in SPELLINGS:
        text = text.replace(f" {one} ", f" {other} ")
    return text.strip(" ")


def known_digests(known: tuple[tuple[str, str], ...] = KNOWN) -> list[tuple[str, str]]:
    """(digest, licence) of each known text, once each."""
    listed = {(digest, name) for name, _, digest in KNOWN_DIGESTS} if known is KNOWN else set()
    return sorted(listed | {(hashlib.sha256(canonical_text(t).encode()).hexdigest(), name) for name, t in known})


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, text_license (of the whole text), licenses (of all units, sorted, with commas), n_notices
    (known units of the kind that has most: lines, blocks or the whole text)."""
    spark: SparkSession = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(known_digests() if known is None else known, "digest string, license string"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("low"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "low"))
    anchored = rows.where(F.col("low").rlike(ANCHOR))
    blocks = F.split("low", r"\n[ \t]*\n")
    lines = F.split("low", r"\n")
    units = F.concat(
        F.array(F.struct(F.lit("text").alias("kind"), F.col("low").alias("unit"))),
        F.when(F.size(blocks) > 1, F.transform(blocks, lambda u: F.struct(F.lit("block").alias("kind"), u.alias("unit")))).otherwise(F.array()),
        F.when(F.size(lines) > 1, F.transform(lines, lambda u: F.struct(F.lit("line").alias("kind"), u.alias("unit")))).otherwise(F.array()),
    )
    each = anchored.select("doc_id", "row_key", F.inline(units)).where(F.col("unit").rlike(ANCHOR))
    each = each.withColumn("digest", F.sha2(canonical(F.col("unit")), 256))
    hits = each.join(table, "digest").groupBy("doc_id", "row_key").agg(
        F.max(F.when(F.col("kind") == "text", F.col("license"))).alias("text_license"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.sum(F.when(F.col("kind") == "line", 1).otherwise(0)).alias("lines"),
        F.sum(F.when(F.col("kind") == "block", 1).otherwise(0)).alias("blocks"),
        F.sum(F.when(F.col("kind") == "text", 1).otherwise(0)).alias("whole"),
    )
    # repeated rows have one key; their units were counted once for each of them
    same = rows.groupBy("doc_id", "row_key").agg(F.count("*").alias("copies")).withColumnsRenamed({"doc_id": "_id", "row_key": "_key"})
    joined = same.join(hits, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("row_key")), "left")
    found = F.coalesce(F.greatest("lines", "blocks", "whole"), F.lit(0)) / F.col("copies")
    joined = joined.withColumn("n_notices", found.cast("long"))
    each_copy = joined.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each_copy.select(F.col("_id").alias("doc_id"), "text_license", F.coalesce("licenses", F.lit("")).alias("licenses"), "n_notices")
