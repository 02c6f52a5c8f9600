"""Licence scans by a trained paragraph classifier.

A text is read at three levels: blocks between blank lines (wrapped lines belong together), sentences, and lines. Each of
these paragraphs is the set of its word n-grams (1 to 3 words, A-Z folded) as hashes, and each is scored: multinomial
logistic regression over licence families and "unknown", fitted on paragraphs made from templates (excerpts, dropped and
added words, changed case), on licences outside the families, on licence-like sentences, and on whole ordinary lines
drawn from anywhere in at most SAMPLE documents. Families that didn't teach (every second one of OTHERS) and held-out
paragraphs calibrate the temperature and the unknown class. A prediction counts if its probability reaches THRESHOLD
and templates confirm it: half of the paragraph's word pairs (of a block's, DENSE) are in the family's templates or, for
sentences and lines that no such paragraph meets, most of one template is in it. Anything else is unknown. What a block doesn't give, its sentences may, then its lines.

The model is made on the driver and is of fixed size; a scan is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Hasher, Members, chunks, map_arrow, mix, utf8

SAMPLE, LINES, THRESHOLD, SHARED, CONTAINED, ROUNDS, MADE, SEED = 400, 6, 0.6, 0.5, 0.8, 160, 90, 11
#: Word pairs of a template that can confirm by being contained; the share that blocks need, as they hold several sentences.
LEAST, DENSE = 4, 0.85

# Customary notices and opening sentences of the licences.
TEMPLATES: dict[str, list[str]] = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Licensed under the MIT License, see LICENSE for details.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "MIT License", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.", "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and limitations under the License.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "Licensed under the GPLv3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.", "GNU General Public License Version 3, 29 June 2007"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GPLv2.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GNU General Public License Version 2, June 1991", "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-3.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "BSD": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "Proprietary": ["All rights reserved.", "Copyright 2020 Example Company. All rights reserved.", "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential."],
}
# Sentences that speak of licences or rights without naming a family.
UNKNOWN = [
    "Released under a custom license.", "See the license file for details.", "This work is licensed under a commercial agreement.", "The software is distributed under its own terms.", "He lost his driving license last year.", "A license is required to sell food here.",
    "The rights of the people are reserved to the states.", "Permission to enter was granted by the owner.", "The general public was admitted free of charge.", "Copies of the report can be obtained from the author.", "The version of the story was not confirmed.", "Public domain images were used for the cover.",
    "The terms of the contract were published by the foundation.", "The license of the station was not renewed.", "Under the terms of the treaty the land was divided.", "Creative work in common spaces is encouraged.", "The notice must appear in all rooms.", "Unless required by law, no names are published.",
    "Licensed premises close at midnight.", "This project is released under the license of its sponsor.",
]

# Notices of licences outside the families, which are unknown: some teach that, the others calibrate it.
OTHERS: dict[str, list[str]] = {
    "0BSD": ["Released under the BSD Zero Clause License.", "Licensed under the Zero-Clause BSD license.", "SPDX-License-Identifier: 0BSD"],
    "Zlib": ["Released under the zlib license.", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"],
    "WTFPL": ["Released under the Do What The Fuck You Want To Public License.", "SPDX-License-Identifier: WTFPL"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1"],
    "Artistic-2.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2.", "Licensed under the European Union Public License, version 1.2.", "SPDX-License-Identifier: EUPL-1.2"],
    "PostgreSQL": ["Released under the PostgreSQL License.", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"],
}
FILLER = "our small tool the code in this folder example data module page team build notes for details".split()

FAMILIES = [*TEMPLATES, "unknown"]
SIZES = (1, 2, 3)
_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True


def tokens(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word; bounds: the n + 1 offsets of texts that adjoin one another."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _TOKEN[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[first], ends[first[1:] - 1] = inside[first], inside[first[1:] - 1]
    starts = np.flatnonzero(begins)
    return Hasher(raw, lower=True)(starts, np.flatnonzero(ends) + 1), starts


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words, by their first word."""
    n = max(0, len(words) - size + 1)
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return total


_BLANK = re.compile(rb"\n(?:[ \t\r]*\n)+")
_SENTENCE = re.compile(rb"[.;:!?](?=[ \t\r\n])")


def levels(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Offsets of the blocks, the sentences and the lines of texts that adjoin one another. A sentence ends with a block."""
    data = raw.tobytes()
    blocks = np.array([m.end() for m in _BLANK.finditer(data)], np.int64)
    sentences = np.array([m.end() for m in _SENTENCE.finditer(data)], np.int64)
    lines = np.flatnonzero(raw == 10) + 1
    blocks = np.unique(np.concatenate([offsets, blocks]))
    return [blocks, np.unique(np.concatenate([blocks, sentences])), np.unique(np.concatenate([offsets, lines]))]


@dataclass
class Scanner:
    """Sorted n-gram hashes with weights [feature, family], biases, the temperature, and the templates' word pairs."""

    wanted: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    pairs: np.ndarray  # sorted hashes of template word pairs
    owners: np.ndarray  # [pair, family]
    parts: np.ndarray  # [pair, template]: 1 / the template's pairs, for templates of LEAST pairs or more
    family_of: np.ndarray  # family of each of these templates

    def read(self, raw: np.ndarray, offsets: np.ndarray, features: Members, pairs: Members):
        """What `judge` needs of texts: word starts, and (size, word, feature) of the n-grams and pairs of interest."""
        words, starts = tokens(raw, offsets)
        found = [(size, *features.hits(grams(words, size))) for size in SIZES]
        return starts, found, pairs.hits(grams(words, 2))

    def judge(self, read, bounds: np.ndarray):
        """(family index, probability, share of the paragraph's word pairs in each family's templates, the largest part of
        one of the family's templates that the paragraph holds) of each paragraph."""
        starts, found, (pair_at, pair) = read
        n, width = len(bounds) - 1, len(self.wanted)
        unit = np.searchsorted(bounds, starts, "right") - 1
        keys = [np.zeros(0, np.int64)]
        for size, at, w in found:
            same = unit[at] == unit[at + size - 1]
            keys.append(unit[at[same]] * width + w[same])
        key = np.unique(np.concatenate(keys))  # an n-gram counts once a paragraph
        scores = np.stack([np.bincount(key // width, self.weights[key % width, f], n) for f in range(len(self.bias))], axis=1) + self.bias
        scores /= self.temperature
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        named = np.minimum(best, self.owners.shape[1] - 1)
        same = unit[pair_at] == unit[pair_at + 1]
        pair_unit, pair = unit[pair_at[same]], pair[same]
        count = np.bincount(unit[:-1][unit[:-1] == unit[1:]], minlength=n)
        share = np.stack([np.bincount(pair_unit, self.owners[pair, f], n) for f in range(self.owners.shape[1])], axis=1) / np.maximum(count, 1)[:, None]
        once = np.unique(pair_unit * len(self.pairs) + pair)
        pair_unit, pair = once // len(self.pairs), once % len(self.pairs)
        held = np.zeros(n)
        for t, family in enumerate(self.family_of.tolist()):
            mine = (named[pair_unit] == family) & (self.parts[pair, t] > 0)
            if mine.any():
                held = np.maximum(held, np.bincount(pair_unit[mine], self.parts[pair[mine], t], n))
        return best, p[np.arange(n), best], share, held


def _make(r: random.Random, text: str) -> str:
    """A variant of a template: maybe an excerpt, a few words lost or added, other case."""
    words = text.split()
    if len(words) > 14 and r.random() < 0.6:
        size = r.randint(12, len(words))
        begin = r.randrange(len(words) - size + 1)
        words = words[begin : begin + size]
    if len(words) > 7:
        words = [w for w in words if r.random() > 0.04]
    if r.random() < 0.4:
        extra = r.sample(FILLER, r.randint(1, 3))
        words = [*extra, *words] if r.random() < 0.5 else [*words, *extra]
    out = " ".join(words)
    return r.choice([out, out, out, out.upper(), out.lower(), f"Copyright (c) {r.randint(1995, 2025)}. {out}"])


def _bag(texts: list[str], sizes=SIZES) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all n-grams of texts."""
    import pyarrow as pa

    raw, at = utf8(pa.array(texts, pa.string()))
    words, starts = tokens(raw, at)
    unit = np.searchsorted(at, starts, "right") - 1
    found = []
    for size in sizes:
        h = grams(words, size)
        same = np.flatnonzero(unit[: len(h)] == unit[size - 1 : size - 1 + len(h)])
        found.append((h[same], unit[same]))
    return np.concatenate([h for h, _ in found]), np.concatenate([own for _, own in found])


def known_features() -> np.ndarray:
    """Sorted hashes of the n-grams that a model may use."""
    return np.unique(_bag([t for ts in [*TEMPLATES.values(), *OTHERS.values(), UNKNOWN] for t in ts])[0])


def fit_scanner(ordinary: list[list[int]], rounds: int = ROUNDS, seed: int = SEED) -> Scanner:
    """The classifier fitted on made paragraphs and ordinary lines (their known features); the same at every run."""
    r = random.Random(seed)
    known, other = known_features(), len(FAMILIES) - 1
    texts, label, held = [], [], []

    def learn(text, family, apart):
        texts.append(text), label.append(family), held.append(apart)

    for k, family in enumerate(TEMPLATES):
        for text in TEMPLATES[family]:
            learn(text, k, False)
        for _ in range(MADE):
            learn(_make(r, r.choice(TEMPLATES[family])), k, r.random() < 0.25)
    for nth, family in enumerate(OTHERS):
        for _ in range(MADE // 2):
            learn(_make(r, r.choice(OTHERS[family])), other, nth % 2 == 1)
    for text in [*UNKNOWN, *(_make(r, r.choice(UNKNOWN)) for _ in range(4 * MADE))]:
        learn(text, other, r.random() < 0.25)
    h, row = _bag(texts)
    hit, column = Members(known).hits(h)
    lines = np.repeat(np.arange(len(ordinary)), [len(x) for x in ordinary]) + len(texts)
    held += [r.random() < 0.25 for _ in ordinary]
    row, column = np.concatenate([row[hit], lines]), np.concatenate([column, np.array([w for x in ordinary for w in x], np.int64)])
    y, held = np.array(label + [other] * len(ordinary)), np.array(held)
    pair = np.unique(row * len(known) + column)
    row, column = pair // len(known), pair % len(known)
    weights, bias = np.zeros((len(known), len(FAMILIES))), np.zeros(len(FAMILIES))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, bias)]
    order = np.argsort(column, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], column[order][1:] != column[order][:-1]]))
    rows_first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))

    def scores():
        out = np.tile(bias, (len(y), 1))
        out[row[rows_first]] += np.add.reduceat(weights[column], rows_first)
        return out

    target = np.eye(len(FAMILIES))[y] * ~held[:, None]
    for step in range(1, rounds + 1):
        s = scores()
        p = np.exp(s - s.max(axis=1, keepdims=True))
        left = (target - p / p.sum(axis=1, keepdims=True) * ~held[:, None]) / (~held).sum()
        g = np.zeros_like(weights)
        g[column[order][first]] = np.add.reduceat(left[row[order]], first)
        for param, grad, m in zip((weights, bias), (g - 1e-4 * weights, left.sum(axis=0)), moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * grad
            m[1] = 0.99 * m[1] + 0.01 * grad * grad
            param += 0.05 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    s = scores()[held]

    def loss(pair):
        z = s / pair[0]
        z[:, other] += pair[1]
        z = z - z.max(axis=1, keepdims=True)
        return -(z[np.arange(len(z)), y[held]] - np.log(np.exp(z).sum(axis=1))).mean()

    temperature, more = min(((t, b) for t in (0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0) for b in (-1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0)), key=loss)
    bias[other] += more * temperature
    flat = [(k, np.unique(_bag([t], (2,))[0])) for k, family in enumerate(TEMPLATES) for t in TEMPLATES[family]]
    pairs = np.unique(np.concatenate([own for _, own in flat]))
    owners = np.zeros((len(pairs), other))
    for k, own in flat:
        owners[np.isin(pairs, own), k] = 1
    long = [(k, own) for k, own in flat if len(own) >= LEAST]
    parts = np.stack([np.isin(pairs, own) / len(own) for _, own in long], axis=1)
    return Scanner(known, weights, bias, temperature, pairs, owners, parts, np.array([k for k, _ in long]))


def _sampled_lines(per_text: int):
    """Known features of so many whole lines of each text, the first in the order of their hashes. Lines that share three
    words in a row with a template are left out, as are blank ones."""
    known = known_features()
    close = np.unique(_bag([t for ts in TEMPLATES.values() for t in ts], (3,))[0])

    def run(batches):
        import pyarrow as pa

        features, near = Members(known), Members(close)
        for batch in batches:
            raw, at = utf8(batch.column(0))
            rows = []
            for _, _, part, offsets in chunks(raw, at):
                bounds = levels(part, offsets)[2]
                words, starts = tokens(part, offsets)
                unit = np.searchsorted(bounds, starts, "right") - 1
                n = len(bounds) - 1
                fine = np.bincount(unit, minlength=n) > 0
                three = near.hits(grams(words, 3))[0]
                fine[unit[three[unit[three] == unit[three + 2]]]] = False
                sums = np.zeros(n, np.uint64)
                np.add.at(sums, unit, words)
                doc = np.searchsorted(offsets, bounds[:-1], "right") - 1
                order = np.lexsort((mix(sums), doc))
                order = order[fine[order]]
                nth = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
                chosen = np.zeros(n, bool)
                chosen[order[nth < per_text]] = True
                own: dict[int, set] = {int(i): set() for i in np.flatnonzero(chosen)}
                for size in SIZES:
                    hit, w = features.hits(grams(words, size))
                    keep = chosen[unit[hit]] & (unit[hit] == unit[hit + size - 1])
                    for i, x in zip(unit[hit[keep]].tolist(), w[keep].tolist(), strict=True):
                        own[i].add(x)
                rows += [sorted(x) for x in own.values()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], ["features"])

    return run


def fit(docs: DataFrame, most: int = SAMPLE, lines: int = LINES) -> Scanner:
    """The scanner. What is unknown is also taught by whole lines, at most `lines` of each of at most `most` documents,
    from anywhere in them; only their known features reach the driver. An empty table teaches nothing."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text")
    rows = map_arrow(texts, _sampled_lines(lines), "features array<long>").groupBy("features").count().toArrow().to_pylist()
    return fit_scanner(sorted(r["features"] for r in rows for _ in range(min(r["count"], 50))))


#: White space and marks of comments and tables around a paragraph.
_AROUND = b" \t\r\n|#*/"


def _spans(model: Scanner, part: np.ndarray, offsets: np.ndarray, features: Members, pairs: Members, threshold: float, share: float, contained: float):
    """(document, family, start, end, probability) of the licence paragraphs in bytes of the chunk, in order."""
    read, every = model.read(part, offsets, features, pairs), levels(part, offsets)
    free, found, edge = np.ones(len(part) + 1, np.int64), [], set(every[0].tolist())
    judged = [model.judge(read, bounds) for bounds in every]
    # Blocks first; then sentences and lines that are all licence, then those that hold some.
    for level, by_share in ((0, True), (1, True), (2, True), (1, False), (2, False)):
        bounds, (family, p, shares, held) = every[level], judged[level]
        n, shared = len(family), shares[np.arange(len(family)), np.minimum(family, shares.shape[1] - 1)]
        good = (family < len(FAMILIES) - 1) & (p >= threshold) & (shared >= (share if level else max(share, DENSE)) if by_share else held >= contained)
        before = np.concatenate([[0], np.cumsum(free)])
        open_ = before[bounds[1:]] - before[bounds[:-1]] == np.diff(bounds)
        taken: dict[int, tuple[int, float]] = {i: (int(family[i]), float(p[i])) for i in np.flatnonzero(good & open_).tolist()}
        for i, own in list(taken.items()) if level and by_share else ():
            for step in (1, -1):  # neighbours in the block that the family's templates confirm go with it
                j = i + step
                while 0 <= j < n and j not in taken and open_[j] and int(bounds[max(j, j - step)]) not in edge and shares[j, own[0]] >= share:
                    taken[j] = own
                    j += step
        found += [(int(bounds[i]), int(bounds[i + 1]), *own) for i, own in taken.items()]
        for a, b, *_ in found:
            free[a:b] = 0
    out: list[list] = []
    for a, b, family, p in sorted(found):
        doc = int(np.searchsorted(offsets, a, "right")) - 1
        if out and out[-1][0] == doc and out[-1][1] == family and out[-1][3] == a and not _BLANK.search(part[max(0, a - 2) : a].tobytes()):
            out[-1][3:] = [b, max(p, out[-1][4])]  # sentences and lines that adjoin one another are one
        else:
            out.append([doc, family, a, b, p])
    return out


def _scan(model: Scanner, threshold: float, share: float, contained: float):
    def run(batches):
        import pyarrow as pa

        features, pairs = Members(model.wanted), Members(model.pairs)
        kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for batch in batches:
            raw, at = utf8(batch.column(1))
            rows = []
            for lo, hi, part, offsets in chunks(raw, at):
                found: list[list] = [[] for _ in range(hi - lo)]
                for doc, family, a, b, p in _spans(model, part, offsets, features, pairs, threshold, share, contained):
                    body = part[a:b].tobytes()
                    a += len(body) - len(body.lstrip(_AROUND))
                    start = int(np.count_nonzero((part[offsets[doc] : a] & 0xC0) != 0x80))
                    size = len(body.strip(_AROUND).decode("utf-8", "replace"))
                    found[doc].append({"family": FAMILIES[family], "start": start, "end": start + size, "probability": p})
                rows += found
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "paragraphs"])

    return run


def scan(docs: DataFrame, model: Scanner, threshold: float = THRESHOLD, share: float = SHARED, contained: float = CONTAINED) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, paragraphs (array of family, start, end in code points without white
    space and comment marks around, probability), in order. Null, empty and other texts without licence paragraphs have an empty array;
    whole texts are read, however long; of families of equal probability the first counts; repeated rows are scanned
    alike; other columns of docs, whatever their names, are left out; an empty table gives an empty result."""
    return map_arrow(docs.select("doc_id", "text"), _scan(model, threshold, share, contained), "doc_id long, paragraphs array<struct<family:string,start:long,end:long,probability:double>>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, fit(docs))
    spans = F.array_join(F.transform("paragraphs", lambda p: F.concat_ws(":", p["family"], p["start"], p["end"])), ",")
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("paragraphs", lambda p: p["family"]))), ",")
    return found.select("doc_id", F.size("paragraphs").cast("long").alias("n_paragraphs"), families.alias("families"), F.round(F.array_max(F.transform("paragraphs", lambda p: p["probability"])), 4).alias("best"), spans.alias("spans"))
