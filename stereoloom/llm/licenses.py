"""License scans by sentence rules.

Sentences are normalised and mapped to identifiers of known licence
sentences; the sequence of identifiers a document shows is matched against
rules, each an ordered list of identifiers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stereoloom.llm import common as c

# Sentences of public licences and notices, in the words of those texts.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "Released under CC0 1.0.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "gpl2-only-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-title-3": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-title-2": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl-title-3": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-title-21": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl-title-3": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gnu-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-copy-2": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-title": "Mozilla Public License Version 2.0",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "epl2-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc-by-work": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-work": "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-work": "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-work": "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-nd-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-notice": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-code": "Creative Commons Attribution 4.0 International Public License",
    "cc-by-sa-code": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "cc0-code": "CC0 1.0 Universal",
    "cc-bound": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\").",
    "cc-sa-bound": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License (\"Public License\").",
    "cc0-statement": "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\").",
    "reserved": "All rights reserved.",
}
# Licence rules in order of preference; each lists sentences that must follow one another.
RULES = [
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-3.0-only", ("gpl3-only", "gpl-hope")),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope")),
    ("GPL-2.0-only", ("gpl2-only-2", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-program", "gpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope")),
    ("GPL-3.0", ("gpl-title-3", "gnu-verbatim")),
    ("GPL-2.0", ("gpl-title-2", "gnu-verbatim")),
    ("LGPL-3.0", ("lgpl-title-3", "gnu-verbatim")),
    ("LGPL-2.1", ("lgpl-title-21", "gnu-verbatim")),
    ("AGPL-3.0", ("agpl-title-3", "gnu-verbatim")),
    ("MPL-2.0", ("mpl-header", "mpl-copy")),
    ("MPL-2.0", ("mpl-header", "mpl-copy-2")),
    ("MPL-2.0", ("mpl-title",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant-2", "isc-warranty")),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("Unlicense", ("unlicense-domain", "unlicense-grant")),
    ("BSL-1.0", ("boost-title",)),
    ("BSL-1.0", ("boost-notice",)),
    ("Zlib", ("zlib-warranty", "zlib-liable", "zlib-grant")),
    ("EPL-2.0", ("epl2-header",)),
    ("Apache-2.0", ("apache-title", "apache-terms")),
    ("Apache-2.0", ("apache-header", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-header", "apache-copy")),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("CC-BY-4.0", ("cc-by-code", "cc-bound")),
    ("CC-BY-SA-4.0", ("cc-by-sa-code", "cc-sa-bound")),
    ("CC0-1.0", ("cc0-code", "cc0-statement")),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-work",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-work",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-work",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-notice",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-notice",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("all-rights-reserved", ("reserved",)),
]
#: Other sentences that may stand between two of one rule.
GAP = 2
_END = np.zeros(256, dtype=bool)
_END[[0x21, 0x2E, 0x3A, 0x3B, 0x3F]] = True  # ! . : ; ?


#: Words that mark a comment line; other marks are punctuation and count for nothing anyway.
_LEADER = re.compile(rb"^[ \t]*@?(?:rem|dnl)(?=[ \t\r]|$)", re.MULTILINE)


def _pieces(texts: list[bytes]) -> tuple[c.Words, np.ndarray, np.ndarray]:
    """Words of the texts, first word of every piece, and whether a sentence must begin there.

    Words are lower-case without ASCII punctuation and comment leaders. A
    piece ends at a line's end or at ``. ! ? : ;`` before white space or the
    text's end; a sentence ends at such a mark, a blank line or the text's end.
    """
    lower = [t.decode().lower().encode() for t in texts]
    lower = [_LEADER.sub(b"", t) if b"rem" in t or b"dnl" in t else t for t in lower]
    w = c.Words(lower, c.PLAIN)
    n = len(w.hashes)
    lines, marks = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for d, text in enumerate(lower):
        a, b = int(w.first[d]), int(w.first[d + 1])
        if a == b:
            continue
        raw = np.frombuffer(text, dtype=np.uint8)
        stop = np.zeros(len(raw), dtype=bool)
        stop[:-1] |= _END[raw[:-1]] & c.SPACE[raw[1:]]
        lines[a:b] = np.searchsorted(np.flatnonzero(raw == 0x0A), w.starts[a:b])
        marks[a:b] = np.searchsorted(np.flatnonzero(stop), w.starts[a:b])
    hard, new = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    hard[1:] = (w.doc[1:] != w.doc[:-1]) | (marks[1:] != marks[:-1]) | (lines[1:] > lines[:-1] + 1)
    new[1:] = hard[1:] | (lines[1:] != lines[:-1])
    start = np.flatnonzero(new)
    return w, start, hard[start]


@dataclass
class SentenceRules:
    """Known sentences as hashes, their lengths in words, rules as sequences of their numbers."""

    hashes: np.ndarray
    numbers: list[int]
    lengths: list[int]
    rules: list[tuple[str, tuple[int, ...]]]

    @classmethod
    def build(cls, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> SentenceRules:
        number = {name: i for i, name in enumerate(sentences)}
        known, lengths = {}, set()
        for name, text in sentences.items():
            w, _, _ = _pieces([text.encode()])
            n = len(w.hashes)
            known[int(w.spans(np.array([0]), np.array([n]))[0])] = number[name]
            lengths.add(n)
        order = sorted(known)
        return cls(np.array(order, dtype=np.uint64), [known[h] for h in order], sorted(lengths, reverse=True), [(name, tuple(number[s] for s in seq)) for name, seq in rules])

    def sequences(self, texts: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """Text index to its (sentence position, identifier) pairs, in order.

        A known sentence may run over any number of whole pieces, so wrapped
        lines are joined and a line can still be a sentence of its own. Where
        several begin, the longest counts; they do not overlap.
        """
        w, start, hard = _pieces(texts)
        out: dict[int, list[tuple[int, int]]] = {}
        if not len(start):
            return out
        ends = np.append(start[1:], len(w.hashes))
        last = np.append(w.first[1:], len(w.hashes))[w.doc[start]]  # where each piece's text ends
        runs: dict[int, tuple[int, int]] = {}  # first piece to (last piece, identifier)
        for size in self.lengths:  # longest first
            to = start + size
            piece = np.searchsorted(ends, to)
            at = np.flatnonzero((to <= last) & (ends[np.minimum(piece, len(ends) - 1)] == to))
            h = w.spans(start[at], to[at])
            near = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            for k in np.flatnonzero(self.hashes[near] == h).tolist():
                runs.setdefault(int(at[k]), (int(piece[at[k]]), self.numbers[near[k]]))
        begin, inside, taken, free = hard.copy(), np.zeros(len(start), dtype=bool), [], 0
        for a in sorted(runs):
            if a < free:
                continue
            b, identifier = runs[a]
            begin[a], inside[a + 1 : b + 1], free = True, True, b + 1
            if free < len(begin):
                begin[free] = True
            taken.append((a, identifier))
        begin &= ~inside
        place = np.cumsum(begin)
        first = np.searchsorted(w.doc[start], np.arange(len(texts)))
        for a, identifier in taken:
            d = int(w.doc[start[a]])
            out.setdefault(d, []).append((int(place[a] - place[first[d]]), identifier))
        return out

    def match(self, sequence: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """(licence, first sentence, last sentence); rules go in order, each from left to right, over sentences no match has taken.

        A rule's sentences follow one another with ``GAP`` others at most
        between two of them; of several places for the next one the nearest
        counts. Untaken sentences form a linked list, and from each start a
        rule looks ``GAP`` sentences ahead for each of its own, so the work
        is linear in the sequence.
        """
        n = len(sequence)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        taken = [False] * n
        starts: dict[int, list[int]] = {}
        for k, (_, identifier) in enumerate(sequence):
            starts.setdefault(identifier, []).append(k)
        out = []
        for name, rule in self.rules:
            for i in starts.get(rule[0], ()):
                took = None if taken[i] else self._fit(sequence, after, i, rule)
                if took:
                    out.append((name, sequence[took[0]][0], sequence[took[-1]][0]))
                    for k in took:
                        taken[k] = True
                        if before[k] >= 0:
                            after[before[k]] = after[k]
                        if after[k] < n:
                            before[after[k]] = before[k]
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    @staticmethod
    def _fit(sequence, after, i, rule):
        took, k = [i], i
        for wanted in rule[1:]:
            k = after[took[-1]]
            while k < len(sequence) and sequence[k][0] - sequence[took[-1]][0] <= GAP + 1 and sequence[k][1] != wanted:
                k = after[k]
            if k >= len(sequence) or sequence[k][0] - sequence[took[-1]][0] > GAP + 1:
                return None
            took.append(k)
        return took


def license_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """Licences that each row's whole text names.

    Returns per row ``doc_id``, ``licenses`` (names in order of first
    sentence, joined by commas, empty if none), ``n_matches`` and
    ``n_sentences`` (known licence sentences found). A null text shows none;
    repeated rows stay repeated; other columns are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast((sentences, rules))

    def run(batches):
        known = SentenceRules.build(*held.value)
        for batch in batches:
            texts = c.utf8(batch.column(1))
            names, matches, found = [""] * len(texts), [0] * len(texts), [0] * len(texts)
            for i, j in c.chunks(texts):
                for d, sequence in known.sequences(texts[i:j]).items():
                    got = known.match(sequence)
                    names[i + d], matches[i + d], found[i + d] = ",".join(x[0] for x in got), len(got), len(sequence)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(matches, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "licenses", "n_matches", "n_sentences"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, licenses string, n_matches long, n_sentences long")
