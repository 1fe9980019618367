"""Verdicts on URLs by host and path rules, and else by a weighted vocabulary.

One Aho-Corasick automaton finds all terms in a pass over the URL. A hit counts where no ASCII letter or digit
touches it. Strict terms weigh as much as the limit and reject alone; soft ones when distinct ones together weigh as much. The
vocabulary is a table of terms and weights, url_terms.csv beside this module or any other.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight of distinct terms that rejects a URL, and the table of terms.
LIMIT, TERMS = 2.0, Path(__file__).with_name("url_terms.csv")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = {65 + k: 97 + k for k in range(26)}


def parts(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((p for c in "/?#" if (p := rest.find(c)) >= 0), default=len(rest))
    path = rest[end:]
    stop = min((p for c in "?#" if (p := path.find(c)) >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


class Rules:
    """(action, host, path) rules; a rule fits its host and its subdomains where the path starts with the rule's."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for action, host, path in rules:
            self.by_host.setdefault(host, []).append((path, action))

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule as host and path, action) of the longest rule that fits; at equal length the longer host, then allow."""
        found = []
        tail = host
        while tail:
            found += [(len(tail) + len(p), len(tail), a == "allow", tail + p, a) for p, a in self.by_host.get(tail, ()) if path.startswith(p)]
            tail = tail.partition(".")[2]
        return max(found)[3:] if found else None


def terms_of(path: str | Path = TERMS) -> dict[str, float]:
    """Terms and weights of a table with the columns term and weight; of a repeated term the last weight counts."""
    with open(path, encoding="utf-8", newline="") as file:
        return {r["term"].strip().translate(_LOWER): float(r["weight"]) for r in csv.DictReader(file) if r["term"].strip()}


class Vocabulary:
    def __init__(self, weights: Mapping[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (term, weight))
        self.automaton.make_automaton()

    def hits(self, url: str) -> dict[str, float]:
        """Distinct terms found with nothing but a boundary beside them, and their weights; they may overlap."""
        text = url.translate(_LOWER)
        found = {}
        for end, (term, weight) in self.automaton.iter(text):
            before, after = end - len(term), end + 1
            if (before < 0 or text[before] not in _LETTERS) and (after == len(text) or text[after] not in _LETTERS):
                found[term] = weight
        return found


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], weights: Mapping[str, float] | None = None, limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (id_col, host, path, rule, verdict, n_strict, n_soft), one for each row of ``pages``.

    The longest rule that fits decides, at equal length the one of the longer host, then an allowing one; rule is null where
    none does, and the vocabulary decides: distinct terms that weigh ``limit`` or more block. n_strict counts terms of that
    weight, n_soft lighter ones. A null or empty URL has empty parts and is allowed. Ids may be null or repeat; other columns are not
    read. weights: lower-case terms, not empty, and what they weigh (a few thousand; every task holds them); by default the table
    beside this module. No data moves between tasks.
    """
    weights = terms_of() if weights is None else dict(weights)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, vocabulary = Rules(rules), Vocabulary(weights) if weights else None
        for batch in batches:
            out = []
            for url in batch.column("url").to_pylist():
                host, path = parts(url)
                hits = vocabulary.hits(url) if url and vocabulary else {}
                rule, action = book.longest(host, path) or (None, None)
                n_strict = sum(w >= limit for w in hits.values())
                out.append((host, path, rule, action or ("block" if sum(hits.values()) >= limit else "allow"), n_strict, len(hits) - n_strict))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.record_batch([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    schema = source.select("id").schema
    for name, kind in (("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string"), ("n_strict", "integer"), ("n_soft", "integer")):
        schema = schema.add(name, kind)
    return source.mapInArrow(judged, schema).withColumnRenamed("id", id_col)
