"""License scans by patience alignment.

A license template is aligned with a text's words: words that occur once in
both are paired, the longest increasing subsequence of the pairs keeps those in
order, and the gaps between these anchors are aligned in the same way, where
more words have become unique. What is left of a gap is matched from its two
ends; a gap without a common unique word is aligned exactly, by a longest common
subsequence over all pairs of equal words. Coverage is the share of the template's words that the alignment pairs.

Templates are whole license texts and short notices. What tells a license from
its likes (name, version, NC, SA, ND, a clause) must be paired word by word, so
a template is aligned around the places of one such phrase only, and words of
the text between the first and the last pair count against it. A text without
the phrases' words costs a pass of set lookups. The scan is a narrow map over
the documents; templates are a small broadcast list.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.llm.common import pieces, table

class License(NamedTuple):
    """A template: phrases of `telling` must be paired word by word, none of `without` may stand in the matched span."""

    name: str
    text: str
    telling: tuple[str, ...]
    without: tuple[str, ...] = ()


#: Fixed notices of common licenses.
TEMPLATES = (
    License("MIT", "Released under the MIT License.", ("MIT License",)),
    License("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("free of charge",)),
    License("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("Apache License, Version 2.0",)),
    License("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("Apache License, Version 2.0",)),
    License("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("GNU General Public License, version 3",)),
    License("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("GNU General Public License, version 2",)),
    *(
        License(name, f"This program is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.", (title, f"version {version} of the License"))
        for name, title, version in (
            ("GPL-3.0", "GNU General Public License", "3"), ("GPL-2.0", "GNU General Public License", "2"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
            ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3"),
        )
    ),
    License("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("CC BY-NC 4.0",)),
    License("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("Creative Commons Attribution 4.0",)),
    License("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("Mozilla Public License, v. 2.0",)),
)
#: What a license is called after "under the" and the like.
CALLED = {
    "MIT": ("MIT License",),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"),
    **{
        f"{short}-{version}": (f"{title}, version {version}", f"{title} v{version}", f"GNU {short}, version {version}", f"GNU {short} v{version}")
        for short, title, version in (
            ("GPL", "GNU General Public License", "2.0"), ("GPL", "GNU General Public License", "3.0"), ("LGPL", "GNU Lesser General Public License", "2.1"),
            ("LGPL", "GNU Lesser General Public License", "3.0"), ("AGPL", "GNU Affero General Public License", "3.0"),
        )
    },
    "CC0-1.0": ("CC0 1.0", "Creative Commons CC0 1.0", "Creative Commons Zero 1.0"),
}
#: The Creative Commons attribution licenses: (id, ways to spell the elements of the name).
VARIANTS = (
    ("BY", ("Attribution",)),
    ("BY-SA", ("Attribution-ShareAlike", "Attribution-Share-Alike")),
    ("BY-ND", ("Attribution-NoDerivatives", "Attribution-NoDerivs", "Attribution-No-Derivatives")),
    ("BY-NC", ("Attribution-NonCommercial", "Attribution-Non-Commercial")),
    ("BY-NC-SA", ("Attribution-NonCommercial-ShareAlike", "Attribution-Non-Commercial-Share-Alike")),
    ("BY-NC-ND", ("Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs", "Attribution-Non-Commercial-No-Derivatives")),
)
LEADS = ("under the", "under", "under a", "under the terms of the")
#: Whole texts in the folder licenses: (file and license, phrases that tell it).
WHOLE = (
    ("MIT", ("free of charge",)),
    ("ISC", ("with or without fee", "provided that the above copyright notice")),
    ("BSD-3-Clause", ("Redistributions in binary form", "endorse or promote products")),
    ("Apache-2.0", ("Apache License Version 2.0, January 2004",)),
    ("GPL-2.0", ("GNU General Public License Version 2, June 1991",)),
    ("GPL-3.0", ("GNU General Public License Version 3, 29 June 2007",)),
    ("LGPL-2.1", ("GNU Lesser General Public License Version 2.1, February 1999",)),
    ("LGPL-3.0", ("GNU Lesser General Public License Version 3, 29 June 2007",)),
    ("MPL-2.0", ("Mozilla Public License Version 2.0",)),
    ("CC0-1.0", ("CC0 1.0 Universal",)),
)
NETWORK = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph. Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General Public License into a single combined work, and to convey the resulting work. The terms of this License will continue to apply to the part which is the covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public License. """
#: Of the words of a template and those that stand between its first and last pair, the share that must be paired.
LEAST_COVERAGE = 0.8
#: Template words are short; a word of the text is a run of letters and digits.
WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
        before[i] = at[pile - 1] if pile else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal words (place in a, place in b), both places increasing."""
    pairs: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a = Counter(a[a0:a1])
        once_b = Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if once_b[b[j]] == 1}
        unique = [(i, place[a[i]]) for i in range(a0, a1) if once_a[a[i]] == 1 and a[i] in place]
        anchors = [unique[k] for k in longest_increasing([j for _, j in unique])]
        pairs += anchors
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            open_ += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
        else:
            # of the places of one word the last comes first, so an increasing subsequence takes one of them at most
            at: dict[str, list[int]] = {w: [] for w in once_a}
            for j in range(b1 - 1, b0 - 1, -1):
                if b[j] in at:
                    at[b[j]].append(j)
            equal = [(i, j) for i in range(a0, a1) for j in at[a[i]]]
            pairs += [equal[k] for k in longest_increasing([j for _, j in equal])]
    return sorted(pairs)


def whole_text(name: str) -> str:
    return pkgutil.get_data(__package__, f"licenses/{name}.txt").decode()


@cache
def all_templates() -> tuple[License, ...]:
    """Notices, names behind a lead, SPDX lines and whole texts.

    The AGPL is the GPL's terms with its own title and section 13; the variants of
    Creative Commons are the BY-SA text with their names and without ShareAlike's
    own parts, so exact copies of these five are covered by a little less than all.
    """
    out = list(TEMPLATES)
    # with a version's .0 left out, the name ends before what may be another version
    called = {name: {*ways, *(w.removesuffix(".0") for w in ways if "GPL" in name or "General" in w)} for name, ways in CALLED.items()}
    for variant, spelled in VARIANTS:
        for version in ("4.0", "3.0"):
            called[f"CC-{variant}-{version}"] = {f"CC {variant} {version}", *(f"Creative Commons {x} {version}" for x in spelled)}
    for name, ways in sorted(called.items()):
        for x in sorted([f"{lead} {way}" for way in ways for lead in LEADS] + [f"SPDX-License-Identifier: {name}"]):
            out.append(License(name, x, (x,)))
    out += [License(name, whole_text(name), telling, ("advertising materials",) if name.startswith("BSD") else ()) for name, telling in WHOLE]
    out.append(License("BSD-2-Clause", whole_text("BSD-2-Clause"), ("Redistributions in binary form", "this list of conditions and the following disclaimer"), ("endorse or promote", "advertising materials")))
    gpl = whole_text("GPL-3.0")
    terms = gpl[gpl.index("TERMS AND CONDITIONS") : gpl.index("  13. Use with")] + NETWORK + gpl[gpl.index("  14. Revised") : gpl.index("END OF TERMS AND CONDITIONS")]
    title = "GNU Affero General Public License Version 3, 19 November 2007"
    out.append(License("AGPL-3.0", title + " " + terms.replace("version 3 of the GNU General", "version 3 of the GNU Affero General", 1), (title,)))
    sa = whole_text("CC-BY-SA-4.0")
    sa = sa[sa.index("Creative Commons Attribution-ShareAlike 4.0 International Public\nLicense") : sa.index("Creative Commons is not a party")]
    plain = sa[: sa.index("  c. BY-SA Compatible")] + sa[sa.index("  d. Copyright and Similar") : sa.index("  b. ShareAlike.")] + sa[sa.index("Section 4 --") :]
    for variant, spelled in VARIANTS:
        text = (sa if variant.endswith("SA") else plain).replace("Attribution-ShareAlike", spelled[0])
        out.append(License(f"CC-{variant}-4.0", text, (f"Creative Commons {spelled[0]} 4.0 International Public License",)))
    return tuple(out)


def starts(phrase: list[str], words: list[str], places: dict[str, list[int]]) -> list[int]:
    """Where the phrase stands in words."""
    k = min(range(len(phrase)), key=lambda i: len(places.get(phrase[i], ())))
    return [p - k for p in places.get(phrase[k], ()) if p >= k and words[p - k : p - k + len(phrase)] == phrase]


def places_of(words: list[str], known: frozenset[str]) -> dict[str, list[int]]:
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in known:
            places.setdefault(w, []).append(i)
    return places


class Template:
    def __init__(self, template: License, least: float):
        self.name, self.words, self.ratio = template.name, words_of(template.text), least
        self.set = frozenset(self.words)
        self.counts = Counter(self.words)
        self.least = -(-int(least * 1000) * len(self.words) // 1000)
        self.telling, self.without = ([words_of(x) for x in phrases] for phrases in (template.telling, template.without))
        self.must = frozenset(w for x in self.telling for w in x)
        own = places_of(self.words, self.set)
        self.own = [starts(x, self.words, own) for x in self.telling]
        assert self.telling and all(self.own), template

    def found(self, words: list[str], places: dict[str, list[int]]) -> tuple[int, int, int] | None:
        """(words paired, first place, last place) of the best region of a text, or none that covers enough.

        Regions lie around each place of the rarest telling phrase. They reach as
        far as a match can that leaves no more than its share of words unpaired.
        """
        if sum(min(n, len(places.get(w, ()))) for w, n in self.counts.items()) < self.least:
            return None
        there = [starts(x, words, places) for x in self.telling]
        if not all(there):
            return None
        k = min(range(len(there)), key=lambda i: len(there[i]) * len(self.own[i]))
        phrase, size = len(self.telling[k]), len(self.words)
        slack = int(size / self.ratio) + 1 - size
        best, top, seen = None, 0.0, set()
        for p in there[k]:
            for t in self.own[k]:
                if p - t in seen:
                    continue
                seen.add(p - t)
                low, high = max(0, p - t - slack), min(len(words), p + size - t + slack)
                if sum(w in self.set for w in words[low:high]) < self.least:
                    continue
                pairs = align(self.words[:t], words[low:p])
                pairs = [(i, low + j) for i, j in pairs] + [(t + i, p + i) for i in range(phrase)]
                pairs += [(t + phrase + i, p + phrase + j) for i, j in align(self.words[t + phrase :], words[p + phrase : high])]
                pairs, share = self.trimmed(pairs, t, t + phrase)
                if len(pairs) < self.least or share < self.ratio or share <= top or not self.tells(dict(pairs)):
                    continue
                first, last = pairs[0][1], pairs[-1][1]
                if any(first <= x <= last for barred in self.without for x in starts(barred, words, places)):
                    continue
                best, top = (len(pairs), first, last), share
                if share == 1:
                    return best
        return best

    def trimmed(self, pairs: list[tuple[int, int]], a: int, b: int) -> tuple[list[tuple[int, int]], float]:
        """The pairs without those ends that bring in more unpaired words than they are worth, and their share."""
        size, n = len(self.words), len(pairs)
        share = lambda i, j: (j - i + 1) / (size + pairs[j][1] - pairs[i][1] + 1 - (j - i + 1))
        # the phrase itself stays
        left = max((i for i in range(n) if pairs[i][0] <= a), key=lambda i: (share(i, n - 1), -i))
        right = max((j for j in range(n) if pairs[j][0] >= b - 1), key=lambda j: (share(left, j), j))
        left = max((i for i in range(n) if pairs[i][0] <= a), key=lambda i: (share(i, right), -i))
        return pairs[left : right + 1], share(left, right)

    def tells(self, pair: dict[int, int]) -> bool:
        """Whether each telling phrase is paired word by word with neighbours in the text."""
        return all(any(t in pair and all(pair.get(t + i) == pair[t] + i for i in range(len(x))) for t in own) for x, own in zip(self.telling, self.own))


FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("matched", T.LongType()), T.StructField("size", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]))
ARROW_FOUND = pa.list_(pa.struct([("license", pa.string()), ("matched", pa.int64()), ("size", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


def scan_licenses(docs: DataFrame, templates: tuple[License, ...] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """docs (text among its columns) with `licenses`: each license found, by its best covered template.

    Words are lower-cased runs of a-z and 0-9. `matched` of the template's
    `size` words were paired, between `first_word` and `last_word` of the text.
    A null or empty text has none. A column `licenses` is replaced. Of templates
    of a license the better covered, then the longer counts; the licenses stand
    in order of their names. No templates given means all. No rows give no rows.
    """
    kept = docs.drop("licenses")
    templates = all_templates() if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Template(t, least) for t in templates]
        telling = frozenset().union(*(t.must for t in own))
        vocabulary = telling.union(*(t.set for t in own), *(x for t in own for x in t.without))
        for batch in pieces(batches):
            out = []
            for text in batch.column("text").to_pylist():
                words = words_of(text or "")
                known = telling.intersection(words)
                best: dict[str, tuple] = {}
                if open_ := [t for t in own if t.must <= known]:
                    places = places_of(words, vocabulary)
                    for t in open_:
                        if x := t.found(words, places):
                            now = (x[0] / len(t.words), len(t.words), *x)
                            if t.name not in best or now[:2] > best[t.name][:2]:
                                best[t.name] = now
                out.append([{"license": n, "matched": x[2], "size": x[1], "first_word": x[3], "last_word": x[4]} for n, x in sorted(best.items())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, ARROW_FOUND)], [*batch.schema.names, "licenses"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("licenses", FOUND)]))


def op10_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    each = F.explode_outer("licenses").alias("x")
    return found.select("doc_id", each).select("doc_id", "x.license", (F.col("x.matched") / F.col("x.size")).alias("coverage"), "x.matched", "x.first_word", "x.last_word")
