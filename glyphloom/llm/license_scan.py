"""License scans: exact containment join of text blocks with license templates."""

from __future__ import annotations

from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import parts

#: The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices by the label that the method gives.
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license version 2.0",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0-notice": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-nc-4.0-notice": "licensed under cc by nc 4.0",
    "gpl-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-later-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc-permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-notice": "released under the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2.0",
}
#: Words are runs of ASCII letters and digits and all bytes from 0x80 on; A-Z become lower case, the rest spaces.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def token_frequencies(texts: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many texts of the whole table each template token stands. One number a token reaches the driver."""

    def count(batches):
        for batch in parts(batches, 0):
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found.update(vocabulary.intersection(words(text)))
            yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["token", "n"])

    rows = texts.mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in rows}


class TemplateIndex:
    """Templates as token sets in global order, rarest first, with an inverted index of their prefixes."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        self.threshold = threshold
        self.sets, self.need, self.size, self.prefix = {}, {}, {}, {}
        for label, text in templates.items():
            tokens = words(text)
            order = sorted(set(tokens), key=lambda t: (frequency.get(t, 0), t))
            if not order:
                continue
            need = ceil(threshold * len(order) - 1e-9)
            self.sets[label], self.need[label], self.size[label] = order, need, len(tokens)
            for at, token in enumerate(order[: len(order) - need + 1]):
                self.prefix.setdefault(token, []).append((label, at))

    def matches(self, found: list[bytes], distinct: set[bytes], slide: bool = False) -> dict[str, float]:
        """label -> best containment of its tokens in a block, of those that reach the threshold.

        A template of s words is sought in blocks of 2s words every s words, so any s consecutive words lie
        in one. Only blocks around one of its prefix tokens can reach the threshold (prefix filter); the block must
        have enough words (length filter), and after the first prefix token met in global order
        enough tokens must remain (positional filter). ``slide``: the block begins at every word, so it does not matter where
        a stretched template starts.
        """
        out: dict[str, float] = {}
        met = [t for t in self.prefix if t in distinct]
        if not met:
            return out
        wanted = {}
        for token in met:
            for label, _ in self.prefix[token]:
                if len(self.sets[label]) and len(distinct) >= self.need[label]:
                    wanted.setdefault(label, set()).add(token)
        if not wanted:
            return out
        every = {t for label in wanted for t in self.sets[label]} if slide else {t for ts in wanted.values() for t in ts}
        places: dict[bytes, list[int]] = {}
        for at, token in enumerate(found):
            if token in every:
                places.setdefault(token, []).append(at)
        for label, tokens in wanted.items():
            s, order, need = self.size[label], self.sets[label], self.need[label]
            if slide:
                have = self._most(places, tokens, order, 2 * s)
                if have >= need:
                    out[label] = have / len(order)
                continue
            blocks = {k for t in tokens for at in places[t] for k in (at // s - 1, at // s) if k >= 0}
            for k in blocks:
                block = set(found[k * s : k * s + 2 * s])
                if len(block) < need:
                    continue
                first = next(at for at, t in enumerate(order) if t in block)
                if len(order) - first < need:
                    continue
                have = sum(t in block for t in order)
                if have >= need:
                    out[label] = max(out.get(label, 0.0), have / len(order))
        return out


    @staticmethod
    def _most(places: dict[bytes, list[int]], tokens: set[bytes], order: list[bytes], width: int) -> int:
        """The most different tokens of a template in ``width`` words in a row that hold a prefix token."""
        near = np.array(sorted(at for t in tokens for at in places[t]))
        at = np.concatenate([np.array(places.get(t, []), np.int64) for t in order])
        kind = np.repeat(np.arange(len(order)), [len(places.get(t, [])) for t in order])
        after = np.searchsorted(near, at)
        far = np.minimum(np.abs(near[np.minimum(after, len(near) - 1)] - at), np.abs(near[np.maximum(after - 1, 0)] - at))
        on = np.flatnonzero(far < width)
        on = on[np.argsort(at[on])]
        best, left, held = 0, 0, {}
        at, kind = at[on].tolist(), kind[on].tolist()
        for right, k in enumerate(kind):
            held[k] = held.get(k, 0) + 1
            while at[right] - at[left] >= width:
                held[kind[left]] -= 1
                if not held[kind[left]]:
                    del held[kind[left]]
                left += 1
            best = max(best, len(held))
        return best


def phrase_places(found: list[bytes], phrases: list[tuple[bytes, int, str]]) -> tuple[int, int | None, int | None, set[str]]:
    """(places, first word, last word, labels) of phrases, given as (spaced bytes, -, label)."""
    joined = b" " + b" ".join(found) + b" "
    n, first, last, labels = 0, None, None, set()
    for phrase, _, label in phrases:
        at, word, before = joined.find(phrase), 0, 0
        while at >= 0:
            word, before = word + joined.count(b" ", before, at), at
            n, first, last = n + 1, word if first is None else min(first, word), word if last is None else max(last, word)
            labels.add(label)
            at = joined.find(phrase, at + 1)
    return n, first, last, labels


_OUT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: all places of the phrases' words in a row. The method adds the labels of every template of which some
    block, beginning at any word, holds at least ``threshold`` of the distinct words. score: 1 with a base place, else the best
    containment found, else 0. The token order comes from the document frequencies of the whole table. Two
    passes over the texts, no shuffle of them. Null and empty texts have no words; label strings are then
    empty. Repeated rows give repeated rows; other columns are left out. Templates and phrases are
    parameters of the caller, not data.
    """
    ship(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    vocabulary = {t for text in templates.values() for t in words(text)}
    index = TemplateIndex(templates, token_frequencies(docs.select(text_col), vocabulary), threshold)
    spaced = [(b" " + b" ".join(words(p)) + b" ", 0, label) for p, label in phrases.items()]

    def judge(batches):
        for batch in parts(batches, 1):
            rows: list[list] = [[] for _ in _OUT]
            for text in batch.column(1).to_pylist():
                found = words(text)
                n, first, last, base = phrase_places(found, spaced)
                method = index.matches(found, set(found), slide=True)
                score = 1.0 if n else max(method.values(), default=0.0)
                for column, value in zip(rows, (len(found), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | method.keys())), score), strict=True):
                    column.append(value)
            yield pa.record_batch([batch.column(0), *(pa.array(c, f.type) for c, f in zip(rows, _OUT, strict=True))], names=[id_col, *_OUT.names])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(judge, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
