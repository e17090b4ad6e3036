"""License notices in documents.

Words of a text go by in overlapping windows, some for each size of template.
A window's shingles have minimum hashes, one for each band; a template with an
equal one is retrieved, and kept if enough of its shingles are in the window
exactly. Bands hold one hash each, and a size has so many that a window with
an occurrence retrieves its template but for a chance of ``MISS``, whatever
else the window holds. Windows without any shingle made of template words
alone share none with a template, and are passed over.
"""

from __future__ import annotations

import functools
import importlib.resources
import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame

from vellum.llm import common

WORDS = 5
MISS = 1e-4
SEED = 5
_WORD = re.compile(r"\w+")

# Public license notices.
TEMPLATES = {
    "mit-notice": ("MIT", "Released under the MIT License."),
    "mit-licensed": ("MIT", "This project is licensed under the terms of the MIT license."),
    "mit-text": ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "apache-notice": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "apache-header": ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "gpl3-notice": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "gpl3-header": ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "gpl2-header": ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "lgpl-header": ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "bsd-text": ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "isc-text": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "mpl-header": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "unlicense": ("Unlicense", "This is free and unencumbered software released into the public domain."),
    "cc-by-nc-notice": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "cc-by-notice": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-notice": ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
}
# End of fixed values.

#: Whole texts of public licenses beside this module, verbatim: file to license.
WHOLE = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@functools.lru_cache(1)
def _default() -> dict[str, tuple[str, str]]:
    """The notices above and the whole texts: name to license and text."""
    at = importlib.resources.files("vellum.llm") / "license_texts"
    return TEMPLATES | {f"{name.lower()}-whole": (kind, (at / f"{name}.txt").read_text(encoding="utf-8")) for name, kind in WHOLE.items()}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)]


def bands(size: int, window: int, share: float) -> int:
    """Hashes that a window of so many words needs for a template of so many."""
    have = size - WORDS + 1
    least = math.ceil(share * have - 1e-9)
    likeness = least / (have + window - WORDS + 1 - least)
    return math.ceil(math.log(MISS) / math.log(1 - likeness)) if likeness < 1 else 1


class Scanner:
    """Templates by size, with their minimum hashes."""

    def __init__(self, templates: tuple[tuple[str, str], ...], share: float):
        self.share = share
        self.templates = [(name, words_of(text)) for name, text in templates]
        if any(len(w) < WORDS for _, w in self.templates):
            raise ValueError(f"a template has fewer than {WORDS} words")
        self.words: dict[str, int] = {}
        runs = [np.array([self.words.setdefault(w, len(self.words) + 1) for w in words]) for _, words in self.templates]
        self.known = np.unique(np.concatenate([self._rolled(r) for r in runs]))
        self.sets = [frozenset(shingles(w)) for _, w in self.templates]
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, (_, words) in enumerate(self.templates):
            by_size[math.ceil(math.log(len(words), 1.5))].append(k)
        rng = np.random.default_rng(SEED)
        self.sizes = []
        for own in by_size.values():
            longest = max(len(self.templates[k][1]) for k in own)
            window = 2 * longest
            n = max(bands(len(self.templates[k][1]), window, share) for k in own)
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
            b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            heads = np.array([self._least(self._hashes(shingles(self.templates[k][1])), a, b) for k in own])
            self.sizes.append((own, window, max(1, longest // 2), a, b, heads, min(math.ceil(share * len(self.sets[k]) - 1e-9) for k in own)))

    @staticmethod
    def _hashes(parts: list[str]) -> np.ndarray:
        import xxhash

        return np.array([xxhash.xxh64_intdigest(p.encode()) for p in parts], np.uint64)

    @staticmethod
    def _least(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = h[None, :] * a[:, None] + b[:, None]
        return (mixed ^ mixed >> np.uint64(31)).min(axis=1)

    @staticmethod
    def _rolled(ids: np.ndarray) -> np.ndarray:
        """A number for each run of as many words as a shingle has."""
        out = np.zeros(max(0, len(ids) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(out)].astype(np.uint64)
        return out

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, containment, begin, end) of the best place of each
        template found, words from 0.

        A window is looked at if as many of its shingles are those of some
        template as the least of its size needs."""
        words = words_of(text)
        if len(words) < WORDS:
            return []
        get = self.words.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        if not ids.any():
            return []
        rolled = self._rolled(ids)
        at = np.searchsorted(self.known, rolled).clip(0, len(self.known) - 1)
        total = np.concatenate([[0], np.cumsum(self.known[at] == rolled)])
        best: dict[int, tuple[float, int, int]] = {}
        if not total[-1]:
            return []
        for own, window, stride, a, b, heads, need in self.sizes:
            last = max(0, -(-(len(words) - window) // stride))
            starts = np.arange(last + 1) * stride
            stops = np.minimum(starts + max(1, window - WORDS + 1), len(rolled))
            for start in starts[total[stops] - total[np.minimum(starts, len(rolled))] >= need].tolist():
                parts = shingles(words[start : start + window])
                if not parts:
                    continue
                least = self._least(self._hashes(parts), a, b)
                for t in np.flatnonzero((heads == least[None, :]).any(axis=1)).tolist():
                    k = own[t]
                    hit = [i for i, p in enumerate(parts) if p in self.sets[k]]
                    share = len({parts[i] for i in hit}) / len(self.sets[k])
                    if share >= self.share - 1e-12:
                        place = (-share, start + hit[0], start + hit[-1] + WORDS)
                        if k not in best or place < best[k]:
                            best[k] = place
        return sorted((self.templates[k][0], -s, i, j) for k, (s, i, j) in best.items())


@functools.lru_cache(4)
def _scanner(templates: tuple[tuple[str, str], ...], share: float) -> Scanner:
    return Scanner(templates, share)


def license_matches(df: DataFrame, templates: dict[str, tuple[str, str]] | None = None, *, id_col: str = "doc_id", text_col: str = "text", share: float = 0.8) -> DataFrame:
    """(doc_id, template, license, containment, begin, end): for every
    document and template (name to license and text, a bounded table) whose
    five-word shingles the document holds to at least ``share``, the best
    place, the first of equal ones, as words from 0, end exclusive. Words are
    runs of word characters, lower-cased. Templates are the notices and whole
    texts of this package, or ``templates``.

    Windows are twice as long as the longest template of a size and overlap by
    three quarters, so that what stands within one and a half times a
    template's length lies in one; it is found with a chance of ``MISS`` less
    than one.

    One pass, no shuffle. Null, empty and short documents hold none; repeated
    rows are each scanned, a null doc_id stays null, other columns are not
    looked at, texts of any length are scanned whole, an empty table gives an
    empty one.
    """
    chosen = _default() if templates is None else templates
    texts = tuple((name, text) for name, (_, text) in chosen.items())
    kinds = {name: kind for name, (kind, _) in chosen.items()}
    _scanner(texts, share)

    def make():
        tool = _scanner(texts, share)

        def apply(ids, rows):
            out = [(i, name, kinds[name], s, a, b) for i, t in zip(ids, rows) for name, s, a, b in tool.scan(t)]
            return dict(zip(("doc_id", "template", "license", "containment", "begin", "end"), zip(*out) if out else [[]] * 6))

        return apply

    return common.map_documents(common.documents(df, id_col, text_col), make, "doc_id long, template string, license string, containment double, begin int, end int")
