"""License scans: Aho-Corasick for tags and notices, shunting-yard for expressions.

A text's A-Z are lower-cased and its words are runs of 0-9, a-z and non-ASCII
characters. One automaton finds all notice phrases as whole consecutive words,
and the words of the identifier tag. Where the tag stands, the expression after
it is read from the line: ids, ``and``, ``or``, ``with`` and brackets become
postfix order by the shunting-yard rule (with before and before or, all to the
left), and the postfix is evaluated: the ids it names, and whether one may
choose terms that are all permissive (or: either side, and: both sides, with:
the license before it). A broken expression gives its known ids and no choice.

The score is 0 without evidence; else 1 - product of (1 - weight) over the
distinct labels, where a tag weighs 0.9, a base phrase 0.5, another notice 0.7.

Edge cases: null and empty texts have no words and no labels; overlapping
phrases all count; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from normlens.llm.frames import map_batches, ready, texts_of

#: The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices of the method.
NOTICES = {
    "licensed under the apache license": "apache-2.0",
    "permission is hereby granted free of charge": "mit",
    "released under the mit license": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "public domain": "public-domain",
}
TAG = "spdx license identifier"
PERMISSIVE = ("apache-", "mit", "bsd", "isc", "zlib", "0bsd", "unlicense", "cc0-", "cc-by-3", "cc-by-4", "bsl-1")
WEIGHTS = {"tag": 0.9, "notice": 0.7, "base": 0.5}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TAG = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+\-:]*")


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard; None if brackets, operators or ids do not fit together."""
    out, stack, operand = [], [], True  # operand: an id or an opening bracket must come next
    for token in tokens:
        low = token.lower()
        if low in PRECEDENCE:
            if operand:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand:
                return None
            out.append(low.rstrip(".:"))
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """The license ids, and whether permissive terms can be chosen."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in PRECEDENCE:
            (right, may_right), (left, may_left) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, may_left))
            else:
                stack.append((left | right, may_left or may_right if token == "or" else may_left and may_right))
        else:
            stack.append(({token}, token.startswith(PERMISSIVE)))
    return stack[0]


def read_expression(text: str) -> tuple[set[str], bool | None]:
    """Ids and choice of the expression at the beginning of a text; text after it is left out."""
    tokens, operand, depth = [], True, 0
    for token in _TOKEN.findall(text):
        low = token.lower()
        if low in PRECEDENCE or token == ")":
            if operand or token == ")" and not depth:
                break
            depth -= token == ")"
            operand = token != ")"
        elif operand:
            depth += token == "("
            operand = token == "("
        else:
            break
        tokens.append(token)
    postfix = to_postfix(tokens)
    if not postfix:
        return {t.lower().rstrip(".:") for t in tokens if t not in "()" and t.lower() not in PRECEDENCE}, None
    return evaluate(postfix)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    kinds: dict[str, list[tuple[str, str]]] = {TAG: [("tag", "")]}
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICES)):
        for phrase, label in phrases.items():
            kinds.setdefault(phrase, []).append((kind, label))
    for phrase, found in kinds.items():
        made.add_word(f" {phrase} ", (phrase, found))
    made.make_automaton()
    return made


def scan(text: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, permissive) of one text."""
    words = text.translate(_WORDS).split()
    joined = f" {b' '.join(words).decode()} "
    base, labels, places, permissive, tagged = set(), {}, [], None, False
    at = before = 0
    for end, (phrase, found) in automaton().iter(joined):
        start = end - len(phrase)  # of the phrase's first letter; a space stands before it
        for kind, label in found:
            if kind == "tag":
                if tagged:
                    continue
                tagged = True
                for match in _TAG.finditer(text.decode()):
                    ids, choice = read_expression(match[1])
                    labels.update(dict.fromkeys(ids, WEIGHTS["tag"]))
                    permissive = choice if permissive is None else permissive and choice is not False
                continue
            labels[label] = max(labels.get(label, 0), WEIGHTS[kind])
            if kind == "base":
                base.add(label)
                # Matches come by their ends, so a start may lie before the last one.
                before = before + joined.count(" ", at, start) if start >= at else before - joined.count(" ", start, at)
                at = start
                places.append(before - 1)
    rest = 1.0
    for label in sorted(labels):
        rest *= 1 - labels[label]
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), 1 - rest, permissive)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, permissive boolean")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row of ``scan`` for each row of ``docs`` (doc_id, text)."""
    ready(docs.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*[scan(t) for t in texts_of(batch.column("text"))]))
        return pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))], names=names)
    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)
