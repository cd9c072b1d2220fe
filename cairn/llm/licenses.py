"""Licence scans: a positional index of rare licence words, and phrases that a licence cannot lack.

Every licence is a template, a short stretch of its own words. The document
frequency of all template words is counted over the whole corpus (a table as
large as the templates). A template whose key phrase occurs in a text is looked up
by its words with the highest inverse document frequency, as many as no match can
lack altogether; each of their places votes for a relative position, and every
position that can still reach MIN_ALIGNED is aligned word by word. So what else a
text holds, and how long it is, takes nothing from a template.

Besides, all places of a few fixed phrases are counted exactly.

Null and empty texts have no words. Words are compared with A-Z as a-z. Repeated rows
are scanned one by one, whatever their ids; a very long text is scanned whole, in time
that grows with its length. Of several places of a template the best aligned counts. An
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases whose every place is counted, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
    "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software the software is provided as is without warranty of any kind express or implied including but "
    "not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
    "or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
    "from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_THIRD = (
    "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission"
)
_BSD_TAIL = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not "
    "limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the "
    "copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including "
    "but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused "
    "and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way "
    "out of the use of this software even if advised of the possibility of such damage"
)
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
    "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any "
    "means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest "
    "in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our "
    "heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights "
    "to this software under copyright law"
)
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
    "the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims "
    "all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the "
    "author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data "
    "or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
    "performance of this software"
)
_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
    "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
    "applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not "
    "be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in "
    "the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must "
    "not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
    "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
    "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express "
    "or implied see the license for the specific language governing permissions and limitations under the license"
)
_GPL = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
    "published by the free software foundation either version 3 of the license or at your option any later version this program is "
    "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
    "fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu "
    "general public license along with this program"
)
_MPL = (
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
    "file you can obtain one at http mozilla org mpl 2 0"
)

#: Licence texts as published, in lower-case words, and short notices; for each, phrases of which one must occur.
TEMPLATES = {
    "mit": (_MIT, ("permission is hereby granted free of charge",)),
    "mit-notice": ("released under the mit license", ("mit license",)),
    "apache": (_APACHE, ("apache license version 2", "apache license")),
    "apache-notice": ("licensed under the apache license version 2 0", ("apache license version 2", "apache license")),
    "gpl": (_GPL, ("gnu general public license",)),
    "gpl-notice": ("this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    "bsd": (f"{_BSD_HEAD} {_BSD_TAIL}", ("redistribution and use in source and binary forms",)),
    "bsd-3": (f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}", ("redistribution and use in source and binary forms",)),
    "mpl": (_MPL, ("mozilla public license",)),
    "cc-by": ("licensed under cc by 4 0", ("cc by",)),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-sa": ("licensed under cc by sa 4 0", ("cc by sa",)),
    "cc-by-creative": ("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    "proprietary": ("all rights reserved", ("all rights reserved",)),
    "unlicense": (_UNLICENSE, ("free and unencumbered software",)),
    "isc": (_ISC, ("permission to use copy modify and",)),
    "zlib": (_ZLIB, ("must not be misrepresented",)),
}

#: Share of a template's words that must stand at one relative position.
MIN_ALIGNED = 0.6


def label_of(template: str) -> str:
    return {"mit-notice": "mit", "gpl-notice": "gpl", "apache-notice": "apache", "bsd-3": "bsd", "cc-by-creative": "cc-by"}.get(template, template)


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


@dataclass(frozen=True)
class Index:
    """Of each template, the words that are looked up: its rarest in the corpus, and where they stand.

    They cover so many places that no text can hold MIN_ALIGNED of the template without one of them in its place.
    """

    templates: dict[str, list[bytes]]
    keys: dict[str, list[bytes]]
    rare: dict[str, dict[bytes, list[int]]]


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """In how many texts each template word occurs, and the number of texts under the word null."""
    wanted = {w for body, _ in TEMPLATES.values() for w in body.encode().split()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        rows = 0
        for batch in batches:
            for x in batch.column(0):
                seen.update(wanted.intersection(words_of(x.as_py())))
                rows += 1
        names = [None, *(w.decode() for w in seen)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([rows, *seen.values()], pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, text: str = "text") -> Index:
    counts = {r.word: r.n for r in document_frequencies(docs, text).collect()}  # one row for each template word
    total = counts.pop(None, 0)
    templates = {name: body.encode().split() for name, (body, _) in TEMPLATES.items()}
    idf = {w: math.log((total + 1) / (counts.get(w.decode(), 0) + 1)) for body in templates.values() for w in body}
    rare: dict[str, dict[bytes, list[int]]] = {name: {} for name in templates}
    for name, body in templates.items():
        for w in sorted(set(body), key=lambda w: (-idf[w], w)):
            if sum(map(len, rare[name].values())) > len(body) - needed(body):
                break
            rare[name][w] = [i for i, x in enumerate(body) if x == w]
    return Index(templates, {name: [k.encode() for k in keys] for name, (_, keys) in TEMPLATES.items()}, rare)


def needed(body: list[bytes]) -> int:
    """How many words of a template must stand in place."""
    return next(n for n in range(len(body) + 1) if n / len(body) >= MIN_ALIGNED)


def phrase_places(spaced: bytes, phrase: bytes) -> list[int]:
    """Word numbers where ``phrase`` starts in words joined and enclosed by single spaces."""
    wanted = b" " + phrase + b" "
    found, at, word, counted = [], spaced.find(wanted), 0, 0
    while at >= 0:
        word += spaced.count(b" ", counted, at)  # from the last place on
        counted = at
        found.append(word)
        at = spaced.find(wanted, at + 1)
    return found


def match(words: list[bytes], spaced: bytes, index: Index) -> dict[str, float]:
    """Templates found in a text, each with the share of its words that stand at the best relative position."""
    possible = {n for n, keys in index.keys.items() if any(b" " + k + b" " in spaced for k in keys)}
    if not possible:  # no template can be verified, so none needs to be aligned
        return {}
    looked_up = {w for name in possible for w in index.rare[name]}
    places: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        if w in looked_up:
            places.setdefault(w, []).append(i)
    best: dict[str, float] = {}
    for name in possible:
        body, rare = index.templates[name], index.rare[name]
        votes = Counter(i - at for w, standing in rare.items() for i in places.get(w, ()) for at in standing)
        others = len(body) - sum(map(len, rare.values()))
        least = needed(body)
        for shift, n in votes.items():
            if n + others >= least:
                aligned = sum(1 for j, w in enumerate(body) if 0 <= shift + j < len(words) and words[shift + j] == w)
                best[name] = max(best.get(name, 0.0), aligned / len(body))
    return {n: s for n, s in best.items() if s >= MIN_ALIGNED}


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, phrase places (phrase, word) and matches (label, aligned) of every text."""
    index = docs.sparkSession.sparkContext.broadcast(build_index(docs, text))  # as large as the templates
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, places array<struct<label:string,word:long>>, matches array<struct<label:string,aligned:double>>"
    places_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    matches_type = pa.list_(pa.struct([("label", pa.string()), ("aligned", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            counts, places, matches = [], [], []
            for x in batch.column(1):
                words = words_of(x.as_py())
                spaced = b" " + b" ".join(words) + b" "
                counts.append(len(words))
                places.append([{"label": label, "word": i} for phrase, label in PHRASES.items() for i in phrase_places(spaced, phrase.encode())])
                found: dict[str, float] = {}
                for name, aligned in match(words, spaced, known).items():
                    found[label_of(name)] = max(found.get(label_of(name), 0.0), aligned)
                matches.append([{"label": n, "aligned": s} for n, s in sorted(found.items())])
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(places, places_type), pa.array(matches, matches_type)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "places", "matches"])

    return docs.select("doc_id", text).mapInArrow(find, schema)
