"""Licence scans: normalised text against licence templates by Dice's coefficient over word bigrams.

A document's units are its sentences (cut at line ends and after closing punctuation) and its whole
text. A unit is compared with a template only if their numbers of bigrams allow the wanted Dice at
all: with a and b bigrams it is at most 2 min(a, b) / (a + b).

Licences that no unit shows are looked for across the cuts: in sentences joined over the line ends of a paragraph
(lines without letters or digits part paragraphs), and in windows of a template's number of words that hold one of
its bigrams needed for the wanted Dice, starting at each place (at each 32nd of a template of over 32 words). A window
gives way to a better one that it overlaps. Each such licence adds one match.

A match needs so many of a template's bigrams that it holds one of a few words (see _cover); texts with none of
these are done with one search. All in Spark expressions within the row: no shuffle, no join.

Templates are short notices, the customary notices of long licences, and the whole texts of short licences; others can be
given. Cases: null text is empty text and matches nothing. Ties go to the template listed first. Repeated rows
repeat. A unit of one word has no bigram. Units are compared whole, whatever their length. An empty table gives no rows.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import texts

#: Licence notices and the texts of short licences.
TEMPLATES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
        "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    (
        "Apache-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for "
        "additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not "
        "use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., "
        "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free "
        "Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License "
        "for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
        "one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS "
        "OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS "
        "OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from "
        "any source distribution.",
    ),
    (
        "BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to "
        "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
        "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
)


def normal(text: str) -> list[str]:
    return re.sub(r"[^0-9a-zA-Z]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    found = normal(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(found, found[1:])))


def _pairs(unit: Column) -> Column:
    """The distinct word bigrams of a normalised unit."""
    found = F.split(unit, " ")
    return F.array_distinct(F.zip_with(F.slice(found, 1, F.size(found) - 1), F.slice(found, 2, F.size(found)), lambda a, b: F.concat_ws(" ", a, b)))


_PLACE = "struct<s:int,e:int,dice:double,rank:int,name:string>"


def _apart(places: Column) -> Column:
    """Places, in order of their starts, less those that overlap the last one kept and are no better; a better one replaces it."""

    def merge(state: Column, w: Column) -> Column:
        last = state["last"]
        better = F.struct(w["dice"], w["rank"]) > F.struct(last["dice"], last["rank"])
        over = w["s"] < last["e"]
        done = F.when(over, state["done"]).otherwise(F.concat(state["done"], F.array(last)))
        return F.struct(done.alias("done"), F.when(over & ~better, last).otherwise(w).alias("last")).cast(kind)

    kind = f"struct<done:array<{_PLACE}>,last:{_PLACE}>"
    first = F.struct(F.slice(places, 1, 0).alias("done"), F.get(places, F.lit(0)).alias("last")).cast(kind)
    found = F.aggregate(F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), first, merge, lambda x: F.concat(x["done"], F.array(x["last"])))
    return F.when(F.size(places) > 1, found).otherwise(places.cast(f"array<{_PLACE}>"))


def scan(docs: DataFrame, least: float = 0.8, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, license and dice of the best match (null without one), n_matches, licenses (distinct, joined)."""
    known = [(name, len(normal(text)), bigrams(text)) for name, text in templates]
    sizes = [len(grams) for *_, grams in known]
    p, q = Fraction(str(least)).as_integer_ratio()
    low, high = _overlap(min(sizes), least), max(sizes) * (2 * q - p) // p
    # a unit with the wanted Dice misses fewer than `missed` of a template's bigrams, so it holds one of any so many
    cover = _cover([(grams, len(grams) - _overlap(len(grams), least) + 1) for *_, grams in known])
    needed = [[g for g in grams if not cover.isdisjoint(g.split())] for *_, grams in known]
    any_word = r"(?<![0-9a-z])(?:" + "|".join(sorted(cover)) + r")(?![0-9a-z])"
    listed = lambda values: F.array(*map(F.lit, values))
    table = F.array(
        *(
            F.struct(
                F.lit(-k).alias("rank"), F.lit(name).alias("name"), F.lit(len(grams)).alias("n"), listed(grams).alias("grams"),
                F.lit(m).alias("m"), F.lit(-(-m // 32)).alias("stride"), F.lit(_overlap(len(grams), least)).alias("shared"), listed(some).alias("needed"),
            )
            for k, ((name, m, grams), some) in enumerate(zip(known, needed, strict=True))
        )
    )

    dice = lambda t, grams: 2.0 * F.size(F.array_intersect(t["grams"], grams)) / (t["n"] + F.size(grams))
    best = lambda unit: F.array_max(
        F.transform(
            F.filter("_near", lambda t: (unit["n"] * (2 * q - p) >= t["n"] * p) & (t["n"] * (2 * q - p) >= unit["n"] * p)),
            lambda t: F.struct(dice(t, unit["grams"]).alias("dice"), t["rank"].alias("rank"), t["name"].alias("name")),
        )
    )
    spaces = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))

    def hits(units: Column) -> Column:
        """(dice, rank, name) of the best template of each unit that matches one."""
        fit = F.filter(units, lambda u: (spaces(u) >= F.lit(low)) & u.rlike(any_word))
        sized = F.transform(F.transform(fit, _pairs), lambda g: F.struct(F.size(g).alias("n"), g.alias("grams")))
        return F.filter(F.transform(F.filter(sized, lambda u: (u["n"] >= F.lit(low)) & (u["n"] <= F.lit(high))), best), lambda m: m["dice"] >= least)

    def places(t: Column) -> Column:
        """The best windows of a template's size, of all that hold one of its needed bigrams.

        For a long template one start of each stretch is compared first. A window d words further on shares at most d bigrams more and has at most d fewer, so
        a stretch is left out only if none of its windows can match; all starts of the others are compared.
        """
        last = F.size("_grams") - t["m"] + 1  # the last start
        first = lambda i: F.greatest(i - t["m"] + 2, F.lit(0))
        part = lambda i: F.floor(i / t["stride"]).cast("int")
        at = F.filter(F.sequence(F.lit(0), F.size("_grams") - 1), lambda i: F.array_contains(t["needed"], F.get(F.col("_grams"), i)) & (first(i) <= last))
        parts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(part(first(i)), part(F.least(i, last))))))
        grams = lambda start: F.array_distinct(F.slice(F.col("_grams"), start + 1, t["m"] - 1))
        share = lambda own: 2 * (F.size(F.array_intersect(t["grams"], own)) + t["stride"] - 1) * q >= p * (t["n"] + F.size(own) - (t["stride"] - 1))
        hopeful = F.filter(parts, lambda k: share(grams(k * t["stride"])))
        starts = F.flatten(F.transform(hopeful, lambda k: F.sequence(k * t["stride"], F.least(k * t["stride"] + t["stride"] - 1, last))))
        scored = F.transform(
            starts,
            lambda s: F.struct(
                s.alias("s"), (s + t["m"]).alias("e"), dice(t, grams(s)).alias("dice"), t["rank"].alias("rank"), t["name"].alias("name")
            ),
        )
        return _apart(F.sort_array(F.filter(scored, lambda w: w["dice"] >= least)))

    cut = lambda text, mark: F.regexp_replace(text, r"(?<=[.!?])\s+", mark)
    of = lambda test, value: F.when(F.col(test), value)
    out = texts(docs).withColumn("_may", F.lower("text").rlike(any_word))
    out = out.withColumn("_whole", of("_may", F.trim(F.regexp_replace(F.lower("text"), r"[^0-9a-z]+", " "))))
    found = F.split("_whole", " ")
    out = out.withColumn("_grams", of("_may", F.zip_with(F.slice(found, 1, F.size(found) - 1), F.slice(found, 2, F.size(found)), lambda a, b: F.concat_ws(" ", a, b))))
    # the text's bigrams that any template has; only templates that share enough of them can match anything in the text
    every = listed(sorted({g for *_, grams in known for g in grams}))
    out = out.withColumn("_held", of("_may", F.array_intersect("_grams", every)))
    near = F.filter(table, lambda t: F.size(F.array_intersect(t["grams"], F.col("_held"))) >= t["shared"])
    out = out.withColumn("_near", F.when(F.size("_held") >= min(_overlap(n, least) for n in sizes), near)).withColumn("_close", F.coalesce(F.size("_near") > 0, F.lit(False)))
    plain = F.regexp_replace(cut(F.lower("text"), "\n"), r"[^0-9a-z\n]+", " ")
    lines = F.transform(F.split("_plain", "\n", -1), lambda u: F.trim(u))
    out = out.withColumn("_plain", of("_close", plain)).withColumn("_units", of("_close", F.array_append(lines, F.when(F.col("_plain").contains("\n"), F.col("_whole")).otherwise(""))))
    # sentences of paragraphs, joined over their line ends; \x01 stands for a cut
    paragraphs = F.regexp_replace(F.translate(F.lower("text"), "\x01", " "), r"\n(?:[^0-9a-z\n]*\n)+", "\x01")
    joined = F.transform(F.split(F.regexp_replace(cut(paragraphs, "\x01"), r"[^0-9a-z\x01]+", " "), "\x01", -1), lambda u: F.trim(u))
    out = out.withColumn("_joined", of("_close", F.array_except(joined, "_units")))
    out = out.withColumn("_hits", of("_close", hits(F.col("_units")))).withColumn("_over", of("_close", hits(F.col("_joined"))))
    large = F.filter("_near", lambda t: F.size("_grams") >= t["m"] - 1)
    out = out.withColumn("_windows", of("_close", _apart(F.sort_array(F.flatten(F.transform(large, places))))))
    none = F.slice(F.col("_hits"), 1, 0)
    windows = F.coalesce(F.transform("_windows", lambda w: F.struct(w["dice"].alias("dice"), w["rank"].alias("rank"), w["name"].alias("name"))), none)
    more = F.filter(F.concat(F.col("_over"), windows), lambda w: ~F.exists("_hits", lambda m: m["name"] == w["name"]))
    out = out.withColumn("_more", more).withColumn("_all", F.concat("_hits", "_more"))
    top = F.array_max("_all")
    names = lambda c: F.array_distinct(F.transform(c, lambda m: m["name"]))
    return out.select(
        "doc_id", top["name"].alias("license"), top["dice"].alias("dice"), F.coalesce(F.size("_hits") + F.size(names("_more")), F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.array_join(F.array_sort(names("_all")), ","), F.lit("")).alias("licenses"),
    )


def _overlap(n: int, least: float) -> int:
    """The fewest of n template bigrams that a unit with the wanted Dice shares."""
    p, q = Fraction(str(least)).as_integer_ratio()
    return -(-p * n // (2 * q - p))


#: Words that ordinary text holds often.
_COMMON = frozenset(
    ("the", "and", "of", "to", "in", "is", "this", "a", "under", "for", "or", "any", "with", "by", "that", "work", "on", "as", "at", "be", "it", "not", "you", "are", "use",
     "may", "can", "but", "if", "all", "no", "from", "out", "an", "will", "free", "public", "other", "more", "see", "have", "such", "into", "its", "i", "s")
)


def _cover(templates: list[tuple[list[str], int]]) -> set[str]:
    """Words such that of each template's bigrams at least the given number hold one of them: greedily, few and seldom ones."""
    left = {k: (set(grams), count) for k, (grams, count) in enumerate(templates)}
    chosen: set[str] = set()
    while left:
        gain: dict[str, float] = {}
        for grams, count in left.values():
            for word in {w for g in grams for w in g.split()}:
                seldom = 0.01 if word in _COMMON or len(word) < 2 or word.isdigit() else 1.0
                gain[word] = gain.get(word, 0.0) + seldom * min(count, sum(word in g.split() for g in grams)) / count
        best = min(gain, key=lambda w: (-gain[w], w))
        chosen.add(best)
        for k, (grams, count) in list(left.items()):
            rest = {g for g in grams if best not in g.split()}
            count -= len(grams) - len(rest)
            left[k] = (rest, count)
            if count <= 0:
                del left[k]
    return chosen
