"""Licence scan as an exact set-similarity join (operator 4).

Text blocks are joined with licence notices by containment: at least
``THRESHOLD`` of a notice's distinct words stand in the block.  A block is a
line, or a passage over line ends: consecutive lines, those between the first
and the last with fewer words than the notice, of the first its last and of the
last its first words, as many as the notice has.  Of passages that hold each
other only the smallest is given, and none that holds such a line.  Words are put
in one global order, rarest first by their number of documents in the whole
corpus.  A notice of k words that needs r of them is indexed under its first
k - r + 1 words only (prefix filter: a qualifying block holds one of those);
blocks with fewer than r known words fail (length filter); and while a block's
words are merged with a notice's in order, the notice is left as soon as the
words after the position reached cannot make up r (positional filter).  The
notices are a fixed list and so are the words that are counted.

Base phrases are found as consecutive words anywhere in the whole text.

Defined results: null counts as empty; repeated rows are scanned each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detflow.llm.common import WORD_TABLE, read

THRESHOLD = 0.8

# Phrases that decide a label, and notices for the join.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
NOTICES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without permission"),
]
_PHRASES = [(b" " + phrase.encode() + b" ", label) for phrase, label in PHRASES]
_NEWLINE = bytearray(WORD_TABLE)
_NEWLINE[0x0A] = 0x0A
LINE_TABLE = bytes(_NEWLINE)


def vocabulary(notices) -> set[bytes]:
    return {w for _, text in notices for w in text.encode().split()}


def count_words(batches: Iterable[pa.RecordBatch], known: set[bytes]) -> Iterator[pa.RecordBatch]:
    """Documents of each batch that hold each known word."""
    for batch in batches:
        at: Counter = Counter()
        for text in batch.column(0):
            at.update(known.intersection((text.as_py() or "").encode().translate(WORD_TABLE).split()))
        yield pa.RecordBatch.from_arrays([pa.array(at.keys(), pa.binary()), pa.array(at.values(), pa.int64())], ["word", "n"])


class NoticeIndex:
    """Notices under their prefix words, in a global word order."""

    def __init__(self, notices, frequency: dict[bytes, int], threshold: float):
        known = vocabulary(notices)
        self.rank = {w: i for i, w in enumerate(sorted(known, key=lambda w: (frequency.get(w, 0), w)))}
        self.notices, self.prefix, self.lengths = [], {}, []
        for k, (label, text) in enumerate(notices):
            ranks = sorted({self.rank[w] for w in text.encode().split()})
            need = math.ceil(threshold * len(ranks) - 1e-9)
            self.notices.append((label, ranks, need))
            self.lengths.append(len(text.split()))
            for position in range(len(ranks) - need + 1):
                self.prefix.setdefault(ranks[position], []).append(k)
        word_of = {i: w for w, i in self.rank.items()}
        self.prefix_words = {word_of[i] for i in self.prefix}

    def wrapped(self, lines: list[list[bytes]]) -> list[tuple[int, int, str, float]]:
        """(first line, last line, label, containment) of every smallest passage
        over line ends that holds a notice."""
        ranks = [[self.rank.get(w, -1) for w in line] for line in lines]
        starts: dict[int, set[int]] = {}
        for at, line in enumerate(ranks):
            for r in set(line):
                for k in self.prefix.get(r, ()):
                    starts.setdefault(k, set()).add(at)
        found = set()
        for k, places in starts.items():
            label, wanted, need = self.notices[k]
            wanted, length = frozenset(wanted), self.lengths[k]
            runs: set[tuple[int, int, int]] = set()
            for at in places:
                # the lines that a passage through this one can reach
                low, n = at, 0
                while low > 0 and n < length:
                    low -= 1
                    n += len(ranks[low])
                high, n = at, 0
                while high + 1 < len(ranks) and n < length:
                    high += 1
                    n += len(ranks[high])
                if len(wanted.intersection([r for line in ranks[low:high + 1] for r in line])) < need:
                    continue
                for first in range(low, at + 1):
                    held, between = wanted.intersection(ranks[first][-length:]), 0
                    for last in range(first + 1, high + 1):
                        both = held | wanted.intersection(ranks[last][:length])
                        if last >= at and len(both) >= need:
                            runs.add((first, last, len(both)))
                            break
                        held |= wanted.intersection(ranks[last])
                        between += len(ranks[last])
                        if between >= length:
                            break
            alone = [i for i in {i for a, b, _ in runs for i in range(a, b + 1)} if len(wanted.intersection(ranks[i])) >= need]
            for a, b, n in runs:
                inside = any(a <= c and d <= b and (c, d) != (a, b) for c, d, _ in runs)
                if not inside and not any(a <= i <= b for i in alone):
                    found.add((a, b, label, n / len(wanted)))
        return sorted(found)

    def contained(self, block: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every notice that the block holds."""
        mine = {self.rank[w] for w in block if w in self.rank}
        found = []
        for k in {k for r in mine for k in self.prefix.get(r, ())}:
            label, ranks, need = self.notices[k]
            if len(mine) < need:
                continue
            shared = 0
            for position, r in enumerate(ranks):
                if shared + len(ranks) - position < need:
                    break
                shared += r in mine
            if shared >= need:
                found.append((label, shared / len(ranks)))
        return found


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """(word number, label) of every place of a phrase in ' word word ... '."""
    out = []
    for phrase, label in _PHRASES:
        at = joined.find(phrase)
        while at >= 0:
            out.append((joined.count(b" ", 0, at), label))
            at = joined.find(phrase, at + 1)
    return out


def scan_rows(batches: Iterable[pa.RecordBatch], index: NoticeIndex) -> Iterator[pa.RecordBatch]:
    blocks_type = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64()), ("last_line", pa.int64())]))
    for batch in batches:
        out: list[tuple] = []
        for text in batch.column(1):
            data = (text.as_py() or "").encode().translate(LINE_TABLE)
            tokens = data.split()
            places, blocks = [], []
            held = index.prefix_words.intersection(tokens)
            if held:
                joined = b" " + b" ".join(tokens) + b" "
                lines = [line.split() for line in data.split(b"\n")]
                for line, block in enumerate(lines):
                    if not held.isdisjoint(block):
                        blocks += [{"line": line, "label": label, "containment": c, "last_line": line}
                                   for label, c in sorted(set(index.contained(block)))]
                blocks += [{"line": a, "label": label, "containment": c, "last_line": b} for a, b, label, c in index.wrapped(lines)]
                blocks.sort(key=lambda b: (b["line"], b["last_line"], b["label"], b["containment"]))
                places = base_places(joined)
            elif any(all(w in data for w in phrase.split()) for phrase, _ in _PHRASES):
                places = base_places(b" " + b" ".join(tokens) + b" ")
            base = sorted({label for _, label in places})
            labels = sorted({*base, *(b["label"] for b in blocks)})
            out.append((len(tokens), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None),
                        ",".join(base), ",".join(labels), 1.0 if base else max((b["containment"] for b in blocks), default=0.0), blocks))
        columns = list(zip(*out)) if out else [()] * 8
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), blocks_type]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names])


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         notices=tuple(NOTICES), threshold: float = THRESHOLD) -> DataFrame:
    """Per row the phrase places, the labels and every block that holds a notice."""
    known = vocabulary(notices)
    counts = (docs.select(F.col(text_col)).mapInArrow(lambda b: count_words(b, known), "word binary, n long")
              .groupBy("word").agg(F.sum("n").alias("n")).collect())        # a row per word of the notices
    index = NoticeIndex(notices, {bytes(r["word"]): r["n"] for r in counts}, threshold)
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        lambda b: scan_rows(b, index),
        f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, blocks array<struct<line:bigint,label:string,containment:double,last_line:bigint>>")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, read(spark, sf_dir, "documents"))
