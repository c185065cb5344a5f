"""Licence scans by canonical digests: texts that differ in case, punctuation, copyright lines and spelling meet in one hash."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as the same word, and the form that stands for all of them (itself no spelling).
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
    "noncommercial": "non commercial", "sublicense": "sub license", "sublicence": "sub license", "sublicensed": "sub licensed", "sublicenced": "sub licensed",
    "owner": "holder", "owners": "holders", "https": "http",
}

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_AS_IS}"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Known texts by licence; several may share one.
TEXTS = [
    ("MIT", _MIT),
    ("MIT", f"MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT}"),
    ("MIT-0", f"""MIT No Attribution
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
{_AS_IS}"""),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_END),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
]

#: Digests and words of the canonical texts of long licences.
FULL = [
    ("Apache-2.0", "a234fc83edeb0f28515cc56227459c57ef2fc7ceacc843a9163fb2f2fdd0ea66", 1609),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702", 983),
    ("CC0-1.0", "de4b88a2c819a4661af54f735069ed878216da8b4992b919b84afa18cfc0e54c", 1088),
    ("GFDL-1.2", "610a138d87da06825fd88410f8b5de6e6d73095bf2cce810bd5b4d0941534083", 3317),
    ("GFDL-1.3", "b5e307004380d05e7d0e039a9c4d1f3c7c3da7c81fa630832109ba92f6f1a962", 3734),
    ("GPL-1.0", "160c74cee4013ca5418bd3648b4e205c6e0d38b5507407deffe7f5a5a9f31b60", 2070),
    ("GPL-2.0", "652aa03b0e13f5393ad2f49e9e203ef509d88747d904ab36b7ff23bc92c4a6f6", 2978),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", 5684),
    ("LGPL-2.0", "5df277a264b0db9f656dea052fa76d8fbe46620768b01b8f09f76ef719771d95", 4202),
    ("LGPL-2.1", "659bfcbba21e743ae02dd4d5518f6bf275275dfe701b5ff9c9b8d21e24d85589", 4403),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 1231),
    ("MPL-1.1", "fbd0bd861aa0fd5565e3ceb58dee7bf8abad8a3da1c71de301d71ba5d249ffbb", 3788),
    ("MPL-2.0", "d36e027a4e4f0d9382cf0c0929cb343e5f38fb8e5288336eaf44a2007380725e", 2427),
]


def notice_sentences() -> list[tuple[str, str]]:
    """Licences and sentences that name them: each name of each version in each of the usual sentences."""
    names = [
        ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache 2.0 License"), ("MIT", "MIT License"), ("ISC", "ISC License"), ("Zlib", "zlib License"), ("0BSD", "Zero-Clause BSD License"),
        ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", "2-Clause BSD License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "3-Clause BSD License"), ("CC0-1.0", "CC0 1.0"), ("Unlicense", "Unlicense"),
    ]
    for short, long, versions in (("MPL", "Mozilla Public License", ("1.1", "2.0")), ("EPL", "Eclipse Public License", ("1.0", "2.0"))):
        names += [(f"{short}-{v}", f"{name}{between}{v}") for v in versions for name in (long, short) for between in (" ", ", version ")]
    for short, long, versions in (("GPL", "General Public License", ("1.0", "2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("AGPL", "Affero General Public License", ("3.0",))):
        for v in versions:
            for number in {v, v.removesuffix(".0")}:
                names += [(f"{short}-{v}", f"{name}{between}{number}") for name in (f"GNU {long}", f"GNU {short}", short) for between in (" ", ", version ", " v")]
                names.append((f"{short}-{v}", f"{short}v{number}"))
    for kind, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            names += [(f"CC-{kind}-{v}", f"{x} {v}{end}") for x in (f"CC {kind}", f"Creative Commons {long}") for end in ("", " License", " International License" if v == "4.0" else " Unported License")]
    frames = [f"{start}{article}{{}}" for start in ("Licensed under ", "Released under ", "Distributed under ", "Available under ", *(f"This {x} is licensed under " for x in ("work", "software", "file", "project", "program", "text", "document"))) for article in ("", "the ", "a ")]
    return [(licence, frame.format(name)) for licence, name in names for frame in frames] + [(i, f"SPDX-License-Identifier: {i}") for i in dict.fromkeys(i for i, _ in names)]


#: Most known texts: their digests, some 100 bytes each, are broadcast.
MOST_KNOWN = 100_000
#: A line, or the sentences of it before a licence begins, that states a copyright: after the word a sign, a year, or who owns it; no mention inside a text.
COPYRIGHT = r"(?im)^[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|©|[:,]?[ \t]*[0-9]{4}|by\b)|©|\(c\)[ \t]*[0-9]{4})(?:[^\n]*?\.[ \t]+(?:all rights reserved\.?[ \t]+)?(permission|redistribution|licensed|this|use)\b|[^\n]{0,100}$|[^\n]*?\.[ \t]+(?:all rights reserved\.?)?)|^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
SEPARATORS = r"[^\p{L}\p{N}]+"
#: Every known text has one of these words; documents without them have no notices.
KEY = "licen|permission|software|(?:released|distributed|available) under"
#: So does every run that is one, in at least one of its canonical lines.
KEY_WORD = re.compile("licen|permission|software|under")


def canonical(text: Column) -> Column:
    """Words in one case and spelling with one space between: no punctuation, no copyright statements; null counts as empty."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT.replace("(?im)", "(?dim)"), "$1")
    words = F.split(F.trim(F.regexp_replace(F.lower(plain), SEPARATORS, " ")), " ", -1)
    same = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(same[w], w)), " ")


def known_texts(spark: SparkSession, texts: Sequence[tuple[str, str]] | None = None, full: Sequence[tuple[str, str, int]] | None = None) -> DataFrame:
    """digest, licence and n_words of the known texts (default: TEXTS, the notice sentences, and FULL); the first licence of a digest counts."""
    texts, full = [*TEXTS, *notice_sentences()] if texts is None else texts, FULL if full is None and texts is None else full or ()
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "n int, licence string, text string").select("n", "licence", canonical(F.col("text")).alias("c"))
    rows = rows.select("n", "licence", F.sha2("c", 256).alias("digest"), F.size(F.split("c", " ")).alias("n_words"))
    rows = rows.unionByName(spark.createDataFrame([(len(texts) + i, *x) for i, x in enumerate(full)], "n int, licence string, digest string, n_words int"))
    return rows.groupBy("digest").agg(F.min_by("licence", "n").alias("licence"), F.first("n_words").alias("n_words"))


def runs(lines: list[str], known: dict[str, str], counts: np.ndarray) -> list[str]:
    """The licences whose known text is a run of whole canonical lines, in alphabetical order; counts: the words of known texts, each once.

    Only runs with a word that all known texts have are hashed: texts cost in proportion to their lines near such words.
    """
    lines = [x for x in lines if x]
    ends = np.cumsum([0, *(x.count(" ") + 1 for x in lines)])
    keys = np.cumsum([0, *(KEY_WORD.search(x) is not None for x in lines)])
    found = set()
    for c in counts.tolist():
        to = np.minimum(np.searchsorted(ends, ends + c), len(ends) - 1)
        for i in np.flatnonzero((ends[to] == ends + c) & (keys[to] > keys)).tolist():
            if licence := known.get(hashlib.sha256(" ".join(lines[i : int(to[i])]).encode()).hexdigest()):
                found.add(licence)
    return sorted(found)


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licence of every document: the id, digest (SHA-256 of its canonical text), licence (null: unknown), notices.

    licence: the whole text is a known one. notices: the licences whose known text is a run of whole lines of the document,
    however it is wrapped, each once, in alphabetical order. known: digest, licence, n_words as `known_texts` makes them, at most
    MOST_KNOWN (then they are broadcast: no shuffle). Null texts have the digest of the empty text and no licence; null or
    repeated ids and repeated rows keep one row each; other columns don't matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    known = known_texts(spark) if known is None else known
    rows = known.select("digest", "licence", "n_words").limit(MOST_KNOWN + 1).collect()
    if len(rows) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    held = spark.sparkContext.broadcast(({r["digest"]: r["licence"] for r in rows}, np.unique([r["n_words"] for r in rows]).astype(np.int64)))

    @F.pandas_udf("array<string>")
    def notices(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: [] if x is None else runs([*x], *held.value))

    table = F.broadcast(spark.createDataFrame([(r["digest"], r["licence"]) for r in rows], "digest string, licence string"))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    lines = F.when(F.col("text").rlike(f"(?i){KEY}"), F.transform(F.split("text", "\n", -1), canonical))
    found = source.select("id", F.sha2(canonical(F.col("text")), 256).alias("digest"), notices(lines).alias("notices")).join(table, "digest", "left")
    return found.select(F.col("id").alias(id_col), "digest", "licence", "notices")


def _sql_canonical(text: str) -> str:
    plain = rf"regexp_replace({text}, '(?im)^[^\p{{L}}\p{{N}}\n]*(?:copyright[ \t]*(?:\(c\)|©|[:,]?[ \t]*[0-9]{{4}}|by\b)|©|\(c\)[ \t]*[0-9]{{4}})(?:[^\n]*?\.[ \t]+(?:all rights reserved\.?[ \t]+)?(permission|redistribution|licensed|this|use)\b|[^\n]{{0,100}}$|[^\n]*?\.[ \t]+(?:all rights reserved\.?)?)|^[^\p{{L}}\p{{N}}\n]*all rights reserved[^\p{{L}}\p{{N}}\n]*$', '\1', 'g')"
    return rf"array_to_string(list_transform(string_split(trim(regexp_replace(lower({plain}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda w: coalesce(spelling[w], w)), ' ')"


#: The query's SQL, with its own spellings, names and digests.
SCAN_SQL = f"""
WITH s AS (SELECT map {{'acknowledgement': 'acknowledgment', 'analogue': 'analog', 'analyse': 'analyze', 'artefact': 'artifact', 'authorisation': 'authorization', 'authorised': 'authorized', 'calibre': 'caliber', 'cancelled': 'canceled',
  'capitalisations': 'capitalizations', 'catalogue': 'catalog', 'categorise': 'categorize', 'centre': 'center', 'emphasised': 'emphasized', 'favour': 'favor', 'favourite': 'favorite', 'fulfil': 'fulfill', 'fulfilment': 'fulfillment',
  'initialise': 'initialize', 'judgement': 'judgment', 'labelling': 'labeling', 'labour': 'labor', 'licence': 'license', 'licences': 'licenses', 'licenced': 'licensed', 'licencing': 'licensing', 'maximise': 'maximize', 'modelled': 'modeled',
  'modelling': 'modeling', 'offence': 'offense', 'optimise': 'optimize', 'organisation': 'organization', 'organise': 'organize', 'practise': 'practice', 'programme': 'program', 'realise': 'realize', 'recognise': 'recognize',
  'signalling': 'signaling', 'utilisation': 'utilization', 'whilst': 'while', 'wilful': 'willful', 'noncommercial': 'non commercial', 'sublicense': 'sub license', 'sublicence': 'sub license', 'sublicensed': 'sub licensed',
  'sublicenced': 'sub licensed', 'owner': 'holder', 'owners': 'holders', 'https': 'http'}} AS spelling),
names AS (SELECT * FROM (VALUES ('Apache-2.0', 'Apache License, Version 2.0'), ('Apache-2.0', 'Apache License 2.0'), ('Apache-2.0', 'Apache 2.0 License'), ('MIT', 'MIT License'), ('ISC', 'ISC License'), ('Zlib', 'zlib License'), ('0BSD', 'Zero-Clause BSD License'),
    ('BSD-2-Clause', 'BSD 2-Clause License'), ('BSD-2-Clause', '2-Clause BSD License'), ('BSD-3-Clause', 'BSD 3-Clause License'), ('BSD-3-Clause', '3-Clause BSD License'), ('CC0-1.0', 'CC0 1.0'), ('Unlicense', 'Unlicense')) AS k(licence, name)
  UNION ALL SELECT concat(short, '-', v), concat(name, sep, v) FROM (VALUES ('MPL', 'Mozilla Public License', '1.1'), ('MPL', 'Mozilla Public License', '2.0'), ('EPL', 'Eclipse Public License', '1.0'), ('EPL', 'Eclipse Public License', '2.0')) AS m(short, long, v), unnest([short, long]) AS a(name), (VALUES (' '), (', version ')) AS b(sep)
  UNION ALL SELECT concat(short, '-', v), concat(name, sep, number) FROM (VALUES ('GPL', 'General', '1.0'), ('GPL', 'General', '2.0'), ('GPL', 'General', '3.0'), ('LGPL', 'Lesser General', '2.1'), ('LGPL', 'Lesser General', '3.0'), ('AGPL', 'Affero General', '3.0')) AS g(short, long, v),
    unnest([v, replace(v, '.0', '')]) AS n(number), unnest([concat('GNU ', long, ' Public License'), concat('GNU ', short), short]) AS a(name), (VALUES (' '), (', version '), (' v'), ('v')) AS b(sep) WHERE sep <> 'v' OR name = short
  UNION ALL SELECT concat('CC-', kind, '-', v), concat(name, ' ', v, tail) FROM (VALUES ('BY', ''), ('BY-SA', '-ShareAlike'), ('BY-NC', '-NonCommercial'), ('BY-ND', '-NoDerivatives'), ('BY-NC-SA', '-NonCommercial-ShareAlike'), ('BY-NC-ND', '-NonCommercial-NoDerivatives')) AS c(kind, long),
    (VALUES ('1.0'), ('2.0'), ('2.5'), ('3.0'), ('4.0')) AS n(v), unnest([concat('CC ', kind), concat('Creative Commons Attribution', long)]) AS a(name), unnest(['', ' License', CASE WHEN v = '4.0' THEN ' International License' ELSE ' Unported License' END]) AS b(tail)),
sentences AS (SELECT licence, concat(frame, article, name) AS text FROM names, (VALUES (''), ('the '), ('a ')) AS a(article), (VALUES ('Licensed under '), ('Released under '), ('Distributed under '), ('Available under '), ('This work is licensed under '), ('This software is licensed under '),
    ('This file is licensed under '), ('This project is licensed under '), ('This program is licensed under '), ('This text is licensed under '), ('This document is licensed under ')) AS f(frame)
  UNION ALL SELECT DISTINCT licence, concat('SPDX-License-Identifier: ', licence) FROM names),
known AS (SELECT DISTINCT licence, sha256(c) AS digest, len(string_split(c, ' ')) AS n FROM (SELECT licence, {_sql_canonical('text')} AS c FROM sentences, s)
  UNION ALL SELECT * FROM (VALUES ('MIT', '402c34d0a40cd8e70b6b2212e3fd8bff43ce4ce9bcbcf4dd37a08e3bbf7d767c', 164), ('MIT', '5eb4b7aeacabd59a945325e9f1db167909c6bb1f8da56cfe413f2ae244a903ad', 166), ('MIT', 'd98f92794c87301c45c4642fb720fecde2a7c8034f1b3326fe379b17ec164528', 168),
  ('MIT-0', '940280dc5f626732a063c1e17a8713d7ebd36f0daa8abe121ae9087c6959c94d', 142), ('BSD-2-Clause', 'a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30', 186), ('BSD-2-Clause', '447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2', 190),
  ('BSD-3-Clause', '9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2', 217), ('BSD-3-Clause', 'cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15', 221), ('ISC', '217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a', 112),
  ('ISC', 'f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee', 114), ('0BSD', '25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c', 98), ('Zlib', '1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7', 133),
  ('Apache-2.0', '7a46cf4a5d56898d746584f4fe57bdf571d600a8f39d21063431d88929f803c7', 86), ('Apache-2.0', 'a234fc83edeb0f28515cc56227459c57ef2fc7ceacc843a9163fb2f2fdd0ea66', 1609), ('Artistic-1.0-Perl', '08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702', 983),
  ('CC0-1.0', 'de4b88a2c819a4661af54f735069ed878216da8b4992b919b84afa18cfc0e54c', 1088), ('GFDL-1.2', '610a138d87da06825fd88410f8b5de6e6d73095bf2cce810bd5b4d0941534083', 3317), ('GFDL-1.3', 'b5e307004380d05e7d0e039a9c4d1f3c7c3da7c81fa630832109ba92f6f1a962', 3734),
  ('GPL-1.0', '160c74cee4013ca5418bd3648b4e205c6e0d38b5507407deffe7f5a5a9f31b60', 2070), ('GPL-2.0', '652aa03b0e13f5393ad2f49e9e203ef509d88747d904ab36b7ff23bc92c4a6f6', 2978), ('GPL-3.0', 'eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a', 5684),
  ('LGPL-2.0', '5df277a264b0db9f656dea052fa76d8fbe46620768b01b8f09f76ef719771d95', 4202), ('LGPL-2.1', '659bfcbba21e743ae02dd4d5518f6bf275275dfe701b5ff9c9b8d21e24d85589', 4403), ('LGPL-3.0', 'aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be', 1231),
  ('MPL-1.1', 'fbd0bd861aa0fd5565e3ceb58dee7bf8abad8a3da1c71de301d71ba5d249ffbb', 3788), ('MPL-2.0', 'd36e027a4e4f0d9382cf0c0929cb343e5f38fb8e5288336eaf44a2007380725e', 2427)) AS k(licence, digest, n)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, sha256({_sql_canonical('t')}) AS digest FROM d, s),
l AS (SELECT r, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_sql_canonical('x')}), lambda x: x <> '') AS lines FROM d, s WHERE regexp_matches(t, '(?i)licen|permission|software|(?:released|distributed|available) under')),
e AS (SELECT r, lines, i, len(string_split(lines[i], ' ')) AS n FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)),
c AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY i) AS upto FROM e),
p AS (SELECT x.r, sha256(array_to_string(x.lines[x.i : y.i], ' ')) AS digest FROM c x, (SELECT DISTINCT n FROM known) k, c y WHERE y.r = x.r AND y.upto = x.upto - x.n + k.n),
f AS (SELECT r, list_sort(list_distinct(list(licence))) AS notices FROM p JOIN known USING (digest) GROUP BY r)
SELECT w.doc_id, w.digest, known.licence, coalesce(f.notices, []) AS notices FROM w LEFT JOIN known ON known.digest = w.digest LEFT JOIN f ON f.r = w.r"""
