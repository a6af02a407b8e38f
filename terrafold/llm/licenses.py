"""Licence scans: word windows of a normalised text against licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import common



def _gnu(family: str, version: str) -> str:
    """The notice that the licences of the GNU family ask for at the top of a file."""
    name = f"GNU {family}General Public License"
    what = "library" if family in ("Library ", "Lesser ") else "program"
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, "
        f"or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        f"PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    )


# Licences and the notices that they ask for.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS '
        "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
        "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-long": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-header": _gnu("Affero ", "3"),
    "gpl-1.0": "This work is licensed under the GNU General Public License, version 1.",
    "gpl-1.0-header": _gnu("", "1"),
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": _gnu("", "2"),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": _gnu("", "3"),
    "lgpl-2.0-header": _gnu("Library ", "2"),
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-2.1-header": _gnu("Lesser ", "2.1"),
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0-header": _gnu("Lesser ", "3"),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE '
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-short": "Released under the MIT License.",
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "mpl-2.0-short": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to "
        "use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
}
# Templates that are others with a clause more or less.
TEMPLATES |= {
    "0bsd": TEMPLATES["isc"].replace(", provided that the above copyright notice and this permission notice appear in all copies", ""),
    "bsd-3-clause": TEMPLATES["bsd-2-clause"].replace(
        " THIS SOFTWARE",
        " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE",
        1,
    ),
    "mit-0": TEMPLATES["mit"].replace(", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ""),
}
LEAST = 0.85
#: Bigrams that tell licences of one family apart: where a template has one of these, a window must have the same ones.
FAMILY = frozenset(("gnu", x) for x in ("affero", "general", "lesser", "library"))
WORD = re.compile("[A-Za-z0-9]+")

Hit = tuple[int, int, str, float, int]  # first word, last word, template, coefficient, bigrams found less those missing


def normalised(text: str) -> list[str]:
    return [x.lower() for x in WORD.findall(text)]


def pairs(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:], strict=False))


def versions(bigrams: frozenset[tuple[str, str]]) -> frozenset[tuple[str, str]]:
    """The bigrams that tell a version. A window must have those of the template."""
    return frozenset(p for p in bigrams if p[0] in ("version", "v") and p[1].isdigit())


def rank(hit: Hit) -> tuple[int, float, str]:
    """The order of hits, best first: a licence that is there as a whole comes before the notice that is a part of it."""
    return -hit[4], -hit[3], hit[2]


def window(n_words: int, size: int) -> int:
    """Words of the windows that a template of so many words is compared with: its own number, or all of a shorter text."""
    return min(n_words, size)


class Scanner:
    """Templates with their bigram sets, and the bounds that prune them.

    A Dice coefficient of t needs a window of a bigrams against a template of b bigrams with t / (2 - t) <= a / b <= (2 - t) / t,
    and as many as t / (2 - t) * b bigrams of the template. So one of any b - that + 1 bigrams must occur: those with the
    longest words are the template's probes. A text without a word of any probe is done after one pass, and templates without
    a probe word in the text, or too long for it, are done after a look at its words.
    """

    def __init__(self, templates: dict[str, str], least: float):
        self.least, self.ratio = least, least / (2 - least)
        self.size = {k: len(normalised(v)) for k, v in sorted(templates.items())}
        self.sets = {k: frozenset(pairs(normalised(v))) for k, v in sorted(templates.items())}
        self.versions = {k: versions(s) for k, s in self.sets.items()}
        self.probes: dict[str, frozenset[str]] = {}
        self.words = ahocorasick.Automaton()
        for k, s in self.sets.items():
            chosen = sorted(s, key=lambda p: (-max(map(len, p)), p))[: len(s) - self.need(k) + 1]
            self.probes[k] = frozenset(max(pair, key=lambda w: (len(w), w)) for pair in chosen)
            for word in self.probes[k]:
                self.words.add_word(word, word)
        self.words.make_automaton()

    def need(self, name: str) -> int:
        return -int(-(self.ratio * len(self.sets[name]) - 1e-9) // 1)

    def hits(self, text: str) -> list[Hit]:
        """The windows of all templates that reach the least coefficient, by place, then name."""
        probes = {w for _, w in self.words.iter(text.lower())}
        names = [k for k, p in self.probes.items() if not probes.isdisjoint(p)]
        if not names:
            return []
        words = normalised(text)
        bigrams = pairs(words)
        number: dict[tuple[str, str], int] = {}
        code = np.fromiter((number.setdefault(p, len(number)) for p in bigrams), np.int64, len(bigrams))
        out: list[Hit] = []
        for name in names:
            s, w = self.sets[name], window(len(words), self.size[name])
            if not self.ratio * len(s) <= w - 1:
                continue
            known = np.zeros(len(number), np.int64)
            known[[number[p] for p in s if p in number]] = 1
            run = np.concatenate(([0], np.cumsum(known[code])))
            # occurrences of the template's bigrams bound how many of them a window has
            for a in np.flatnonzero(run[w - 1 :] - run[: len(run) - w + 1] >= self.need(name)):
                got = set(bigrams[a : a + w - 1])
                if len(s) * self.ratio <= len(got) <= len(s) / self.ratio:
                    shared = len(got & s)
                    dice = 2.0 * shared / (len(got) + len(s))
                    if dice >= self.least and self.versions[name] <= got and (s.isdisjoint(FAMILY) or got & FAMILY == s & FAMILY):
                        out.append((int(a), int(a) + w - 1, name, dice, 2 * shared - len(s)))
        return sorted(out)

    def places(self, text: str) -> list[Hit]:
        """The hits that overlap taken together: first and last word, and the best hit there by rank."""
        out: list[Hit] = []
        for hit in self.hits(text):
            if out and hit[0] <= out[-1][1]:
                x, y = out[-1][:2]
                out[-1] = (x, max(y, hit[1]), *min(out[-1], hit, key=rank)[2:])
            else:
                out.append(hit)
        return out


@lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...], least: float) -> Scanner:
    return Scanner(dict(templates), least)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, licence, dice and n_hits for each row of docs.

    Words are the runs of ASCII letters and digits of the whole text, in small letters. Every window of as many words as a
    template has, or a shorter text as one, is compared with it. n_hits counts the places with a match, overlapping windows
    of all templates being one. A template's version numbers must be in the window, and its licence of the GNU family must be
    the window's. licence is the template of the best match, null with no match, as for null and empty texts: the one with most
    bigrams found less those missing, so that whole licences come before notices in them, then the largest coefficient, then the
    first name. Null and repeated keys stay; other columns, whatever their names, are not read.
    """
    held = tuple(sorted((templates or TEMPLATES).items()))
    schema = common.row_schema(docs, key, "licence string, dice double, n_hits long")

    def run(batches):
        s = scanner(held, least)
        for b in batches:
            hits = [s.places(x.as_py().decode("utf-8", "replace")) for x in b.column(1)]
            best = [min(h, key=rank) if h else (None,) * 5 for h in hits]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[2] for x in best], pa.string()), pa.array([x[3] for x in best], pa.float64()), pa.array([len(h) for h in hits], pa.int64())], names=schema.names)

    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text")).mapInArrow(run, schema)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))


def _oracle() -> str:
    """Texts that have enough of a template's bigrams anywhere give their windows to it; windows overlap where one starts before
    the largest end of those before."""
    rows = ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in TEMPLATES.items())
    bigrams = lambda t: f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
    least, ratio = LEAST, LEAST / (2 - LEAST)
    family = "[" + ", ".join(f"'{a} {b}'" for a, b in sorted(FAMILY)) + "]"
    kin = lambda t: f"list_sort(list_intersect({t}, {family}))"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents),
l AS MATERIALIZED (SELECT name, len(w) AS k, list_distinct({bigrams('w')}) AS s FROM (
  SELECT name, list_transform(regexp_extract_all(t, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM (VALUES {rows}) v(name, t))),
e AS MATERIALIZED (SELECT rid, unnest(list_distinct({bigrams('w')})) AS b FROM d WHERE len(w) > 1),
c AS MATERIALIZED (SELECT e.rid, f.name FROM e JOIN (SELECT name, len(s) AS n, unnest(s) AS b FROM l) f USING (b)
  GROUP BY e.rid, f.name HAVING count(*) >= {ratio!r}::DOUBLE * any_value(f.n) - 1e-9),
n AS (SELECT rid, name, s, w, least(len(w), k) AS size, unnest(range(1, len(w) - least(len(w), k) + 2)) AS a FROM c JOIN d USING (rid) JOIN l USING (name)),
g AS (SELECT rid, name, s, a, a + size - 1 AS z, list_distinct(list_transform(range(a, a + size - 1), lambda i: w[i] || ' ' || w[i + 1])) AS got FROM n),
h AS (SELECT rid, name, a, z, 2.0::DOUBLE * len(list_intersect(got, s)) / (len(got) + len(s)) AS dice, 2 * len(list_intersect(got, s)) - len(s) AS found FROM g
  WHERE list_has_all(got, list_filter(s, lambda b: regexp_matches(b, '^(version|v) [0-9]+$'))) AND (len({kin('s')}) = 0 OR {kin('s')} = {kin('got')})),
m AS (SELECT *, max(z) OVER (PARTITION BY rid ORDER BY a, z, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h WHERE dice >= {least})
SELECT doc_id, arg_min(name, (-found, -dice, name)) AS licence, arg_min(dice, (-found, -dice, name)) AS dice, count(*) FILTER (dice IS NOT NULL AND (before IS NULL OR a > before)) AS n_hits
FROM d LEFT JOIN m USING (rid) GROUP BY rid, doc_id
"""


ORACLE = _oracle()
