"""Licence scan: Aho-Corasick finds notice phrases and identifier tags; expressions are parsed by shunting-yard."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from dwellmatch.llm.common import map_texts

# The phrases of the base count, as words, with their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Further notices and the label each one speaks for.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "all rights reserved": "proprietary",
}
TAG_PHRASE = "spdx license identifier"

# First part of an identifier, its label, and how much it asks of users
# (0 nothing or notice only, 1 changed files stay open, 2 the whole work stays open).
FAMILIES = {
    "mit": ("mit", 0),
    "apache": ("apache", 0),
    "bsd": ("bsd", 0),
    "isc": ("isc", 0),
    "zlib": ("zlib", 0),
    "bsl": ("bsl", 0),
    "unlicense": ("unlicense", 0),
    "cc0": ("cc0", 0),
    "cc": ("cc-by", 0),
    "mpl": ("mpl", 1),
    "epl": ("epl", 1),
    "cddl": ("cddl", 1),
    "lgpl": ("lgpl", 1),
    "gpl": ("gpl", 2),
    "agpl": ("agpl", 2),
}
OBLIGATIONS = ("permissive", "weak", "strong")

# How sure each kind of finding makes us; several findings add up as independent ones do.
CERTAINTY = {"tag": 0.95, "bad_tag": 0.5, "base": 0.8, "notice": 0.6}

BINDING = {"or": 1, "and": 2, "with": 3}
_TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\(|\)|[a-z0-9.+:-]+")


def postfix(text: str) -> list[str] | None:
    """Shunting-yard: the expression in postfix order; None if it isn't one.

    Precedence is WITH, AND, OR; text after a closing comment mark is not part of it.
    """
    text = re.split(r"\*/|-->|#}|\"\"\"", text)[0]
    if not text.strip() or _TOKEN.sub("", text).strip():
        return None
    out: list[str] = []
    ops: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(text):
        if token == "(":
            if not operand_next:
                return None
            ops.append(token)
        elif token == ")":
            if operand_next:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        elif token in BINDING:
            if operand_next:
                return None
            while ops and ops[-1] != "(" and BINDING[ops[-1]] >= BINDING[token]:
                out.append(ops.pop())
            ops.append(token)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(rpn: list[str]) -> tuple[frozenset[str], int] | None:
    """Labels named, and what must be met: AND asks the most of both sides, OR lets one choose the
    lesser, WITH lowers its licence by one step. None if WITH doesn't join a licence and an exception."""
    stack: list[tuple[frozenset[str], int, str | None]] = []
    for token in rpn:
        if token in BINDING:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                if left[2] is None or right[2] is None:
                    return None
                stack.append((left[0], max(0, left[1] - 1), None))
            else:
                stack.append((left[0] | right[0], (max if token == "and" else min)(left[1], right[1]), None))
        else:
            label, need = FAMILIES.get(re.split(r"[-.+]", token)[0], (token, 2))
            stack.append((frozenset([label]), need, token))
    return stack[0][0], stack[0][1]


def _clean(text: str, table: bytes) -> tuple[int, str]:
    words = text.encode("utf-8", "surrogatepass").translate(table).split()
    return len(words), " " + b" ".join(words).decode("latin-1") + " "


def _table() -> bytes:
    """Bytes to bytes: A-Z lower-cased, the rest of ASCII but letters and digits to space, UTF-8 bytes kept."""
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def scan(texts: list[str | None], automaton, table: bytes) -> dict[str, list]:
    """Findings of each whole text, as columns."""
    cols: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "obligation")}
    for text in texts:
        n_words, line = _clean(text or "", table)
        base: set[str] = set()
        more: set[str] = set()
        starts: list[int] = []
        doubt, tagged = 1.0, False
        for end, (kind, label, length) in automaton.iter(line):
            if kind == "tag":
                tagged = True
                continue
            doubt *= 1 - CERTAINTY[kind]
            if kind == "base":
                base.add(label)
                starts.append(end - length + 1)
            else:
                more.add(label)
        said: list[str] = []
        need = None
        for found in _TAG.findall((text or "").lower()) if tagged else ():
            rpn = postfix(found)
            value = rpn and evaluate(rpn)
            doubt *= 1 - CERTAINTY["tag" if value else "bad_tag"]
            if value:
                said.append(" ".join(rpn))
                more |= value[0]
                need = value[1] if need is None else max(need, value[1])
        cols["n_words"].append(n_words)
        cols["n_base"].append(len(starts))
        cols["first_word"].append(line.count(" ", 0, min(starts)) if starts else None)
        cols["last_word"].append(line.count(" ", 0, max(starts)) if starts else None)
        cols["base_labels"].append(",".join(sorted(base)))
        cols["labels"].append(",".join(sorted(base | more)))
        cols["score"].append(1 - doubt)
        cols["expressions"].append(said)
        cols["obligation"].append(None if need is None else OBLIGATIONS[need])
    return cols


def build_automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    found: dict[str, tuple] = {}
    for kind, phrases in (("notice", NOTICE_PHRASES), ("base", BASE_PHRASES), ("tag", {TAG_PHRASE: ""})):
        for phrase, label in phrases.items():
            found[f" {phrase} "] = (kind, label, len(phrase) + 2)
    for phrase, value in found.items():
        automaton.add_word(phrase, value)
    automaton.make_automaton()
    return automaton


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence findings per document: (id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, expressions, obligation).

    One pass without a shuffle. Words are runs of a-z (A-Z lower-cased), 0-9 and non-ASCII
    characters; phrases are found where their words stand one after another, whatever stands
    between them. ``expressions`` are the valid identifier expressions in postfix order and
    ``obligation`` the strictest of their values. Null and empty texts have no words and no
    findings (labels empty, first and last word null, score 0). Repeated rows each get their row;
    other columns are not looked at; an empty table gives no rows.
    """
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, obligation string"

    def work(texts: list[str | None]) -> dict[str, list]:
        return scan(texts, build_automaton(), _table())

    return map_texts(docs, id_col, text_col, schema, work)
