"""License scan: phrases, and templates with optional and replaceable regions.

A template is the whole wording of a notice, a file header or a license in markup: ``<<optional>> ... <<end>>`` may be missing, ``<<any N>>`` stands
for up to N words of any kind. It is compiled into an automaton over tokens whose states are the
places between its words; optional regions are skipped by empty moves, and replaceable ones
consume any token. A text is accepted where the mandatory wording stands exactly, word for word.
The automaton starts only at words that can begin its template, in texts that hold its rarest word;
replaceable words at a template's very start go before that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, text_bytes

# The phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Parts of licenses that several have in common.
BSD_OPENING = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<optional>> <<any 1>> <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<optional>> <<any 1>> <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
BSD_ADVERTISING = (
    "<<optional>> <<any 1>> <<end>> all advertising materials mentioning features or use of this software must display the following acknowledgement "
    "this product includes software developed by <<any 12>> "
)
BSD_NAMES = (
    "<<optional>> <<any 1>> <<end>> neither the name of <<any 12>> nor the names of <<any 4>> contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission "
)
BSD_WARRANTY = (
    "this software is provided by <<any 12>> as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall <<any 12>> be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business "
    "interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any "
    "way out of the use of this software even if advised of the possibility of such damage"
)

# One-line notices, file headers and whole licenses as templates, by label.
TEMPLATES = {
    "gpl-notice": "<<optional>> this <<any 3>> is <<end>> licensed under the <<optional>> terms of the <<end>> gnu general public license "
    "<<optional>> version <<any 3>> <<end>>",
    "gpl-header": "<<any 4>> is free software you can redistribute it and or modify it under the terms of the gnu general public license "
    "as published by the free software foundation <<optional>> either <<end>> version <<any 2>> of the license <<optional>> or at your option any later version <<end>> "
    "<<any 4>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a "
    "particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with "
    "<<any 4>> if not <<optional>> see http www gnu org licenses <<end>> <<optional>> see https www gnu org licenses <<end>> "
    "<<optional>> write to the free software foundation <<end>>",
    "apache-2.0-notice": "licensed under the apache license <<optional>> version <<end>> 2 0 <<optional>> the license <<end>>",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
    "you may obtain a copy of the license at <<any 12>> unless required by applicable law or agreed to in writing software distributed under the license is "
    "distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing "
    "permissions and limitations under the license",
    "cc-by-notice": "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by <<optional>> <<any 2>> <<end>> 4 0",
    "cc-by-header": "this work is licensed under a creative commons attribution <<any 3>> <<optional>> international <<end>> license",
    "mit-notice": "<<optional>> released <<end>> <<optional>> licensed <<end>> under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following "
    "conditions the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>> shall be included in all copies or "
    "substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<any 8>> be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-2-clause-text": BSD_OPENING + BSD_WARRANTY,
    "bsd-3-clause-text": BSD_OPENING + BSD_NAMES + BSD_WARRANTY,
    "bsd-4-clause-text": BSD_OPENING + BSD_ADVERTISING + BSD_NAMES + BSD_WARRANTY,
    "isc-text": "permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee is hereby granted provided "
    "that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<any 8>> disclaims all warranties with "
    "regard to this software including all implied warranties of merchantability and fitness in no event shall <<any 8>> be liable for any special direct "
    "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
    "tortious action arising out of or in connection with the use or performance of this software",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from "
    "the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
    "redistribute it freely subject to the following restrictions <<optional>> <<any 1>> <<end>> the origin of this software must not be misrepresented you must "
    "not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated "
    "but is not required <<optional>> <<any 1>> <<end>> altered source versions must be plainly marked as such and must not be misrepresented as being the "
    "original software <<optional>> <<any 1>> <<end>> this notice may not be removed or altered from any source distribution",
}

#: Anything that ends a word becomes a space and A-Z lower case; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """The states of a template and what each token leads to."""

    def __init__(self, markup: str):
        parts = re.findall(r"<<[^>]*>>|[^\s<]+", markup)
        #: Words of any kind that may stand before the first state.
        self.lead = int(parts.pop(0).strip("<>").split()[1]) if parts[0].startswith("<<any") else 0
        self.steps: list[dict[bytes | None, set[int]]] = [{}]
        self.empty: list[set[int]] = [set()]
        self.mandatory: list[bytes] = []
        opened: list[int] = []

        def state() -> int:
            self.steps.append({})
            self.empty.append(set())
            return len(self.steps) - 1

        at = 0
        for part in parts:
            if part == "<<optional>>":
                opened.append(at)
            elif part == "<<end>>":
                self.empty[opened.pop()].add(at)
            elif part.startswith("<<any"):
                places = [at]
                for _ in range(int(part.strip("<>").split()[1])):
                    to = state()
                    self.steps[at].setdefault(None, set()).add(to)
                    at = to
                    places.append(at)
                for place in places[:-1]:
                    self.empty[place].add(at)
            else:
                to = state()
                self.steps[at].setdefault(part.encode(), set()).add(to)
                at = to
                if not opened:
                    self.mandatory.append(part.encode())
        self.final = at
        # The longest mandatory word stands in for the rarest.
        self.anchor = max(self.mandatory, key=len)
        self.first = {w for s in self.closed({0}) for w in self.steps[s]}

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return out

    def longest(self, words: list[bytes], at: int) -> int | None:
        """End of the longest accepted stretch that starts at ``at``."""
        states, end = self.closed({0}), None
        while states:
            if self.final in states:
                end = at
            if at == len(words):
                break
            word = words[at]
            states = self.closed({t for s in states for k in (word, None) for t in self.steps[s].get(k, ())})
            at += 1
        return end


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES):
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases.items()]
        self.automata = [(label, Automaton(markup)) for label, markup in templates.items()]
        #: Words without which a text holds no phrase and no template.
        self.needed = {max(p, key=len) for p, _ in self.phrases} | {a.anchor for _, a in self.automata}

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = words_of(text)
        if not self.needed.intersection(words):
            return len(words), 0, None, None, "", "", 0.0
        places: dict[bytes, list[int]] = {}
        heads = {p[0] for p, _ in self.phrases} | {w for _, a in self.automata for w in a.first if w} | self.needed
        for i, w in enumerate(words):
            if w in heads:
                places.setdefault(w, []).append(i)
        starts, base, labels, covered = [], set(), set(), []
        for phrase, label in self.phrases:
            for i in places.get(phrase[0], ()):
                if tuple(words[i : i + len(phrase)]) == phrase:
                    starts.append(i)
                    base.add(label)
                    covered.append((i, i + len(phrase)))
        for label, automaton in self.automata:
            if automaton.anchor not in places:
                continue
            reach = 0
            for i in sorted(x for w in automaton.first for x in places.get(w, ())):
                if i >= reach and (end := automaton.longest(words, i)) is not None:
                    labels.add(label)
                    covered.append((max(reach, i - automaton.lead), end))
                    reach = end
        mask = np.zeros(len(words) + 1, np.int64)
        for a, b in covered:
            mask[a] += 1
            mask[b] -= 1
        share = float((np.cumsum(mask) > 0).sum() / len(words))
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), share


def scanned(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """For each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. n_base
    counts all places of all phrases; first_word and last_word are null without any. score is the
    share of words in phrases and accepted templates. A null text counts as empty: no words, empty
    labels, score 0. Whole texts are scanned, however long. Repeated rows each get their row; other
    columns are ignored. An empty table gives no rows.
    """
    scanner = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        for batch in batches:
            found = [scanner.scan(x.as_py()) for x in batch.column("text")]
            cols = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    bounded_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return read.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
