"""License scans: MinHash bands over overlapping text windows, then exact shingle containment; DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

SHINGLE, PERCENT = 5, 80
#: 64 bands of two minima each. `collision` says with what probability a template meets a window that holds PERCENT % of it.
BANDS, ROWS = 64, 2
#: 64-bit words of the map of template shingles, and of the map that says which window lengths a shingle's templates have.
MAP_WORDS, LENGTH_WORDS = 1024, 4096

#: Public license notices and headers, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "disclaimer", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("0BSD", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def default_templates(spark: SparkSession) -> DataFrame:
    rows = [(i, f"{name} {part}", text) for i, (name, part, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template_id long, template string, text string")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _run(column: str, at: Column, n: int) -> list[Column]:
    """n elements from a place on, null past the end; element by element, as a slice would copy the whole array."""
    return [F.get(column, at + k) for k in range(n)]


def _shingled(df: DataFrame) -> DataFrame:
    """Adds words and shingles: a hash for each run of SHINGLE words."""
    df = df.withColumn("words", _words(F.col("text"))).drop("text")
    at = F.when(F.size("words") >= SHINGLE, F.sequence(F.lit(0), F.size("words") - SHINGLE)).otherwise(F.expr("cast(array() as array<int>)"))
    return df.withColumn("shingles", F.transform(at, lambda i: F.xxhash64(*_run("words", i, SHINGLE))))


def window_length(shingles: int) -> int:
    """The least length of a ladder, each step a quarter longer, that is not under a template's number of shingles."""
    length = 1.0
    while math.ceil(length) < shingles:
        length *= 1.25
    return math.ceil(length)


def spans(length: int) -> tuple[int, int]:
    """Shingles of a window for templates of up to `length`, and how far its next one starts: some window holds any such run whole."""
    return length + math.ceil(length / 2), max(1, length // 2)


def collision(shingles: int) -> float:
    """Least probability that a template meets a window that holds PERCENT % of its (different) shingles in some band."""
    held = math.ceil(shingles * PERCENT / 100)
    alike = held / (spans(window_length(shingles))[0] + shingles - held)
    return 1 - (1 - alike**ROWS) ** BANDS


def _sketch(shingles: Column) -> Column:
    """The key of each band: a hash of ROWS minima, each of its own hash, over a set of shingles."""
    least = lambda seed: F.array_min(F.transform(shingles, lambda x: F.xxhash64(seed, x)))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda band: F.xxhash64(band, *[least(band * ROWS + k) for k in range(ROWS)]))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _longs(values: list[int]) -> Column:
    """A literal array, written as text: one expression, however many values."""
    return F.expr("array(" + ",".join("-9223372036854775808" if v == -(1 << 63) else f"{v}L" for v in values) + ")")


@dataclass(frozen=True)
class _Index:
    strings: DataFrame  # template_id, template, n_shingles, shingle
    bands: DataFrame  # length, band, key, template_id
    map: Column
    lengths_map: Column
    lengths: list[tuple[int, int]]  # length of a window's templates; shingles that the smallest of them needs


def _template_index(templates: DataFrame) -> _Index:
    """What documents are compared with; a bounded table, of which shingle hashes and sizes come to the driver."""
    rows = _shingled(templates.select("template_id", "template", text_or_empty().alias("text"))).filter(F.size("shingles") > 0)
    rows = materialize(rows.withColumn("n_shingles", F.size(F.array_distinct("shingles")).cast("long")), "templates")
    at = F.explode(F.sequence(F.lit(0), F.size("shingles") - 1)).alias("at")
    strings = rows.select("template_id", "template", "n_shingles", "words", at).select("template_id", "template", "n_shingles", F.concat_ws(" ", *_run("words", F.col("at"), SHINGLE)).alias("shingle")).distinct()
    bits, masks, sizes = [0] * MAP_WORDS, [0] * LENGTH_WORDS, {}
    found = rows.select("n_shingles", F.size("shingles").alias("n"), "shingles").collect()
    lengths = sorted({window_length(r["n"]) for r in found})
    for r in found:
        length = window_length(r["n"])
        sizes[length] = min(sizes.get(length, r["n"]), math.ceil(r["n_shingles"] * PERCENT / 100))
        for h in r["shingles"]:
            bits[(h >> 6) % MAP_WORDS] |= 1 << (h % 64)
            masks[(h >> 24) % LENGTH_WORDS] |= 1 << lengths.index(length) % 64
    ladder = F.array(*[F.lit(x) for x in lengths])
    length = F.array_min(F.filter(ladder, lambda x: x >= F.size("shingles"))) if lengths else F.lit(0)
    bands = rows.select("template_id", length.alias("length"), F.posexplode(_sketch(F.col("shingles"))).alias("band", "key"))
    return _Index(strings, materialize(bands, "template-bands"), _longs([_signed(b) for b in bits]), _longs([_signed(m) for m in masks]), [(x, sizes[x]) for x in lengths])


def _windows(index: _Index) -> Column:
    """Windows worth a sketch: those with as many shingles of templates of their length as the smallest of these needs.

    Window w of a length has the shingles from w * step on. `places` holds where template shingles stand, with a bit for each
    length; each names the windows it is in, and a window named often enough is taken.
    """
    kinds = F.array(*[F.struct(F.lit(i % 64).alias("bit"), F.lit(x).alias("length"), F.lit(spans(x)[0]).alias("size"), F.lit(spans(x)[1]).alias("step"), F.lit(need).alias("need")) for i, (x, need) in enumerate(index.lengths)])

    def of_kind(k: Column) -> Column:
        mine = F.filter("places", lambda p: F.getbit(p["lengths"], k["bit"]) == 1)
        named = F.array_sort(F.flatten(F.transform(mine, lambda p: F.sequence(F.greatest(F.ceil((p["at"] - k["size"] + 1) / k["step"]), F.lit(0)).cast("int"), F.floor(p["at"] / k["step"]).cast("int")))))
        often = F.array_distinct(F.filter(named, lambda w, i: F.get(named, i + k["need"] - 1) == w))
        shingles = lambda w: F.array_compact(F.transform(F.sequence(F.lit(0), k["size"] - 1), lambda j: F.get("shingles", w * k["step"] + j)))
        return F.transform(often, lambda w: F.struct(k["length"].alias("length"), shingles(w).alias("shingles")))

    return F.flatten(F.transform(kinds, of_kind))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, most_template_words: int = 200_000) -> DataFrame:
    """Which templates stand in which documents: at least PERCENT % of a template's SHINGLE-word shingles in the text.

    Words are runs of letters and digits, lower-cased. For every length of templates a text's shingles are cut into
    overlapping windows half as long again, so that one holds any run of that length whole. A window is sketched by BANDS
    bands of ROWS minima, as are the templates of its length, and an equal band retrieves the template for the document: with
    a probability of `collision`, 0.9999 or more, where a window has PERCENT % of it. Windows with fewer template shingles
    than the smallest template of their length needs (bit maps say so) can't have that, and are not sketched. Only retrieved
    (document, template) pairs are checked exactly, on the shingles' words, over the whole document; shingles that lie
    scattered, less than PERCENT % of them in any window, are no match. Templates are a bounded table: more than
    most_template_words words are refused, and their index is broadcast.

    Returns doc_id, template_id, template, n_shingles, n_found, first_word (offset of the first shingle found) and
    containment, one row per document and template; rows that repeat a doc_id count as one document. Templates of fewer
    than SHINGLE words match nothing. Null texts are empty; very long texts are cut like others; a row with a null doc_id is
    left out; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    if (templates.agg(F.sum(F.size(_words(text_or_empty())))).first()[0] or 0) > most_template_words:
        raise ValueError(f"the templates have more than {most_template_words} words")
    index = _template_index(templates)
    if not index.lengths:
        return spark.createDataFrame([], "doc_id long, template_id long, template string, n_shingles long, n_found long, first_word long, containment double")
    in_map = lambda h: F.getbit(F.element_at(index.map, F.pmod(F.shiftright(h, 6), F.lit(MAP_WORDS)).cast("int") + 1), F.pmod(h, F.lit(64)).cast("int")) == 1
    lengths = lambda h: F.element_at(index.lengths_map, F.pmod(F.shiftright(h, 24), F.lit(LENGTH_WORDS)).cast("int") + 1)

    rows = _shingled(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    places = F.filter(F.transform("shingles", lambda h, i: F.when(in_map(h), i).otherwise(-1)), lambda i: i >= 0)
    # a filter on places here would be pushed below and compute all anew
    rows = rows.withColumn("places", F.transform(places, lambda i: F.struct(i.alias("at"), lengths(F.get("shingles", i)).alias("lengths"))))
    words = F.transform("places", lambda p: F.struct(p["at"].cast("long").alias("at"), F.concat_ws(" ", *_run("words", p["at"], SHINGLE)).alias("shingle")))
    rows = materialize(rows.select("doc_id", words.alias("found"), _windows(index).alias("windows")), "license-windows")

    windows = rows.select("doc_id", F.explode("windows").alias("window"))
    sketched = windows.select("doc_id", F.col("window.length").alias("length"), F.posexplode(_sketch(F.col("window.shingles"))).alias("band", "key"))
    retrieved = materialize(sketched.join(F.broadcast(index.bands), ["length", "band", "key"]).select("doc_id", "template_id").distinct(), "retrieved")
    found = retrieved.join(rows.select("doc_id", "found"), "doc_id").select("doc_id", "template_id", F.explode("found").alias("x"))
    found = found.select("doc_id", "template_id", F.col("x.shingle").alias("shingle"), F.col("x.at").alias("at")).join(F.broadcast(index.strings), ["template_id", "shingle"])
    exact = found.groupBy("doc_id", "template_id", "template", "n_shingles", "shingle").agg(F.min("at").alias("at"))
    exact = exact.groupBy("doc_id", "template_id", "template", "n_shingles").agg(F.count("*").alias("n_found"), F.min("at").alias("first_word"))
    out = exact.filter(F.col("n_found") * 100 >= F.col("n_shingles") * PERCENT)
    return out.select("doc_id", "template_id", "template", "n_shingles", "n_found", "first_word", F.round(F.col("n_found") / F.col("n_shingles"), 6).alias("containment"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """DuckDB SQL for the default templates: every shingle of every text against all of theirs."""
    values = ", ".join(f"({i}::bigint, {_quoted(f'{n} {p}')}, {_quoted(t)})" for i, (n, p, t) in enumerate(TEMPLATES))
    words = lambda t: f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')"
    run = f"array_to_string(w[i + 1 : i + {SHINGLE}], ' ')"
    return f"""
with templates(template_id, template, t) as (values {values}),
tw as (select template_id, template, {words('t')} as w from templates),
ts as (select distinct template_id, template, {run} as shingle from (select *, unnest(range(0, len(w) - {SHINGLE - 1})) as i from tw)),
tn as (select *, count(*) over (partition by template_id) as n_shingles from ts),
dw as (select doc_id, {words("coalesce(text, '')")} as w from documents where doc_id is not null),
ds as (select doc_id, i as pos, {run} as shingle from (select *, unnest(range(0, len(w) - {SHINGLE - 1})) as i from dw)),
hits as (select doc_id, template_id, template, n_shingles, shingle, min(pos) as pos from ds join tn using (shingle) group by all)
select doc_id, template_id, template, n_shingles, count(*) as n_found, min(pos) as first_word, round(count(*) / n_shingles, 6) as containment
from hits group by doc_id, template_id, template, n_shingles having count(*) * 100 >= n_shingles * {PERCENT}"""
