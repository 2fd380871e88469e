"""License scans: fixed phrases, and template texts found through a positional index of their rarest words.

The document frequency of every word of the templates is counted over all documents; each template is indexed by its words
of highest IDF with their positions. Every place of such a word in a file is looked up, places that agree on the relative
position of the same template are intersected, and a template is reported where its mandatory key phrases stand inside.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that give a label wherever their words stand consecutively.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Public licence notices as (label, text, mandatory key phrases).
TEMPLATES = [
    ("mit",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
     "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
     "sublicense and or sell copies of the software",
     ["permission is hereby granted", "sublicense and or sell copies"]),
    ("apache-2",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
     "copy of the license at",
     ["apache license", "except in compliance with the license"]),
    ("bsd",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("isc",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
     "copyright notice and this permission notice appear in all copies",
     ["with or without fee is hereby granted", "permission notice appear in all copies"]),
    ("gpl",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
     "free software foundation",
     ["gnu general public license", "free software foundation"]),
    ("mpl-2",
     "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
     "can obtain one at",
     ["mozilla public license v 2 0", "source code form is subject to"]),
    ("unlicense",
     "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
     ["free and unencumbered software", "released into the public domain"]),
    ("cc-by-nc",
     "this work is licensed under a creative commons attribution noncommercial international license",
     ["creative commons attribution noncommercial"]),
]

ANCHORS = 10
#: lower case for A-Z; a blank for every other ASCII byte that is no digit or letter
WORD_BYTES = bytes(
    i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
RESULT = ("_id long, _th long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label:string,start:long,stop:long,score:double>>")


def words_of(text: str | None) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split(b" ") if text else []


class LicenceIndex:
    """Phrases and templates of one scan; ``frequency`` gives the documents that hold a template word, of ``total``."""

    def __init__(self, phrases, templates, frequency: dict[bytes, int], total: int, anchors: int = ANCHORS):
        self.phrases = [(label, [w.encode() for w in text.split()]) for label, text in phrases]
        # a phrase is looked for at its rarest word
        self.phrase_at = defaultdict(list)
        for label, words in self.phrases:
            rare = min(range(len(words)), key=lambda i: (frequency.get(words[i], 0), i))
            self.phrase_at[words[rare]].append((label, words, rare))
        self.templates, self.postings = [], defaultdict(list)
        for n, (label, text, keys) in enumerate(templates):
            words = [w.encode() for w in text.split()]
            idf = {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) for w in words}
            rare = set(sorted(idf, key=lambda w: (-idf[w], w))[:anchors])
            places = [(w, p) for p, w in enumerate(words) if w in rare]
            for w, p in places:
                self.postings[w].append((n, p))
            self.templates.append((label, words, [[x.encode() for x in k.split()] for k in keys], len(places)))
        self.lookup = set(self.postings) | set(self.phrase_at)

    def scan(self, words: list[bytes]) -> tuple[list, list]:
        """(phrases as (start, label), templates as (label, start, stop, score))."""
        base, votes = [], Counter()
        for i, w in enumerate(words):
            if w not in self.lookup:
                continue
            for label, phrase, at in self.phrase_at.get(w, ()):
                if i >= at and words[i - at:i - at + len(phrase)] == phrase:
                    base.append((i - at, label))
            for n, p in self.postings.get(w, ()):
                votes[n, i - p] += 1
        spans = []
        for (n, start), count in votes.items():
            label, template, keys, places = self.templates[n]
            if 2 * count < places:
                continue
            lo, hi = max(start, 0), max(start + len(template), 0)
            inside = words[max(lo - len(template) // 4, 0):hi + len(template) // 4]
            if all(_holds(inside, k) for k in keys):
                same = sum(a == b for a, b in zip(template[lo - start:], words[lo:hi]))
                spans.append((label, lo, min(hi, len(words)), same / len(template)))
        return sorted(base), sorted(spans, key=lambda s: (s[1], s[0], s[2]))


def _holds(words: list[bytes], phrase: list[bytes]) -> bool:
    return any(w == phrase[0] and words[i:i + len(phrase)] == phrase for i, w in enumerate(words))


def word_frequency(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """Documents that hold each word of a fixed vocabulary, over all documents; as many rows as the vocabulary come back."""
    def run(batches):
        count = Counter()
        for batch in batches:
            for t in batch["text"].to_pylist():
                count.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.collect()}


def scan_licences(docs: DataFrame, phrases=None, templates=None, anchors: int = ANCHORS) -> DataFrame:
    """One row per row of ``docs``: doc_id, _th, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of phrases; first_word and last_word are their smallest and largest start (null without one). labels adds the
    labels of templates. score is 1 with a phrase, else the best share of template words found in place, else 0. Null and empty texts have no words and
    no labels; repeated rows and null ids are scanned like others; other columns are ignored; an empty table gives an empty result. Runs
    one job to count word frequencies.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    vocabulary = {w.encode() for _, text in phrases for w in text.split()} | {w.encode() for _, text, _ in templates for w in text.split()}
    frequency = word_frequency(docs, vocabulary)
    total = docs.count()

    def run(batches):
        index = LicenceIndex(phrases, templates, frequency, total, anchors)
        for batch in batches:
            out = []
            for i, h, t in zip(*(batch[c].to_pylist() for c in ("_id", "_th", "text"))):
                words = [w for w in words_of(t) if w]
                base, spans = index.scan(words)
                own = sorted({label for _, label in base})
                out.append({"_id": i, "_th": h, "n_words": len(words), "n_base": len(base), "first_word": base[0][0] if base else None,
                            "last_word": base[-1][0] if base else None, "base_labels": ",".join(own),
                            "labels": ",".join(sorted({*own, *(s[0] for s in spans)})),
                            "score": 1.0 if base else max((s[3] for s in spans), default=0.0),
                            "spans": [dict(zip(("label", "start", "stop", "score"), s)) for s in spans]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])
    longs = ["_id", "_th", "n_words", "n_base", "first_word", "last_word"]
    schema = pa.schema([(c, pa.int64()) for c in longs] + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                                                           ("spans", pa.list_(span))])
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"), "text")
    return rows.mapInArrow(run, RESULT).withColumnRenamed("_id", "doc_id")
