"""Line-first quality rules.

Every line is judged by its own shape: punctuation, symbols, shouting, bare
separators, links, repetition inside the line and repetition of an earlier
line; short lines also by set phrases, and by legal marks where they stand at
the document's head or foot.  Failing lines are removed; a document that loses
too much of its text goes.  Base rules on the whole text (too few words,
repeated three-word windows) come on top.  One pass over each text, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = b" \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
# What pages say around their text, in the languages of the corpus.
PHRASES = (
    "all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|enable javascript|click here to|sign up for our|subscribe to our|"
    "lorem ipsum|powered by|back to top|skip to (?:main )?content|spdx-license-identifier|licensed under the|permission is hereby granted|"
    "alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|tous droits réservés|politique de confidentialité|conditions d.utilisation|mentions légales|"
    "todos los derechos reservados|política de privacidad|política de cookies|aviso legal"
)
BOILERPLATE = re.compile(PHRASES, re.IGNORECASE)
#: Legal marks, which tell at a document's head and foot only.
LEGAL = r"©|®|™|\([cC]\) ?(?:19|20)[0-9][0-9]|[cC]opyright "
LEGAL_MARK = re.compile(LEGAL)
#: A word of marks alone: ASCII ones, those of Latin-1, general and CJK punctuation, arrows, boxes, bullets.
MARKS = r"[!-/:-@\[-`{-~\u00a1-\u00bf\u00d7\u00f7\u2010-\u2bff\u3001-\u303f]+"
SEPARATOR = re.compile(rf"(?<![^ \t-\r]){MARKS}(?![^ \t-\r])")
LINKS = r"https?://[^ \t-\r<>]+|www\.[^ \t-\r<>]+|</?[A-Za-z][^<>]*>|\]\([^ \t-\r)]+\)"
LINK = re.compile(LINKS)
#: Sentence and clause marks of Latin, Greek, CJK, Devanagari, Arabic and Ethiopic script.
PUNCTUATION = r"[.,;:!?\u2026\u00b7\u3002\u3001\uff0c\uff01\uff1f\u061f\u060c\u06d4\u0964\u1362]"
ANY_PUNCTUATION = re.compile(PUNCTUATION)

DEFAULTS = {
    "min_words": 50,  # a document of fewer words fails
    "max_repeat": 50,  # percent of words in repeated three-word windows
    "max_lost": 50,  # percent of words on failed lines
    "symbol_share": 0.12,  # symbols to bytes of a line's words
    "nav_share": 0.2,  # bare separators, two or more, to words of a line
    "link_share": 0.5,  # bytes of links and markup to bytes of a line's words
    "shout_words": 8,  # words from which a line is judged for shouting
    "plain_words": 30,  # words from which a line needs any punctuation at all
    "plain_bytes": 360,  # bytes from which a line of long unspaced words does
    "unspaced": 40,  # bytes of a word, on average, where a script has no spaces
    "distinct_words": 12,  # words from which a line is judged for repetition
    "distinct_share": 0.34,
    "phrase_words": 20,  # words up to which a set phrase or legal mark makes the line
    "edge_lines": 3,  # lines with words at the head and at the foot
}


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more, the first included."""
    n = len(words)
    if n < 4:  # two windows at least
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int64, n)
    k = len(ids)
    if k < 1 << 21:  # three ids fit in 63 bits
        key = (x[:-2] * k + x[1:-1]) * k + x[2:]
    else:
        pair = np.unique(x[:-2] * k + x[1:-1], return_inverse=True)[1]
        key = pair * k + x[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] = twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def line_fails(line: str, words: list[bytes], rules: dict = DEFAULTS, edge: bool = False) -> str:
    """The rule that the line breaks, or ''.  ``words`` are the line's own; ``edge``: it stands at the head or foot."""
    n = len(words)
    size = sum(map(len, words))
    if sum(map(line.count, SYMBOLS)) > rules["symbol_share"] * size:
        return "symbols"
    if n >= 4 and len(SEPARATOR.findall(line)) >= max(2, rules["nav_share"] * n):
        return "navigation"
    if any(x in line for x in ("://", "www.", "<", "](")) and len("".join(LINK.findall(line)).encode("utf-8", "surrogatepass")) >= rules["link_share"] * size:
        return "links"
    if n >= rules["shout_words"] and line.count("!") + line.count("\uff01") >= 0.5 * n:
        return "shouting"
    if n >= rules["distinct_words"] and len(set(words)) < rules["distinct_share"] * n**0.9:
        return "repetition"
    if (n >= rules["plain_words"] or size >= max(rules["plain_bytes"], rules["unspaced"] * n)) and not ANY_PUNCTUATION.search(line):
        return "punctuation"
    if n <= rules["phrase_words"] and (BOILERPLATE.search(line) or (edge and LEGAL_MARK.search(line))):
        return "boilerplate"
    return ""


def judge(text: str | None, rules: dict = DEFAULTS) -> dict:
    """Counts, verdict and the cleaned text of one document (null: no words)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six ASCII spaces
    n_words = len(words)
    text = text or ""
    chars = len(text) - sum(raw.count(bytes([c])) for c in SPACE)
    n_repeat = repeated_words(words)
    seen: set[str] = set()
    n_dup = n_lines = n_failed = words_kept = 0
    kept_lines = []
    lines = [(line, line.encode("utf-8", "surrogatepass").split()) for line in text.split("\n")]
    foot = sum(bool(own) for _, own in lines) - rules["edge_lines"]
    for line, own in lines:
        if not own:
            kept_lines.append(line)
            continue
        edge = n_lines < rules["edge_lines"] or n_lines >= foot
        n_lines += 1
        if line in seen:
            n_dup += 1
            n_failed += 1
        else:
            seen.add(line)
            if line_fails(line, own, rules, edge):
                n_failed += 1
            else:
                words_kept += len(own)
                kept_lines.append(line)
    base = n_words < rules["min_words"] or 100 * n_repeat > rules["max_repeat"] * n_words
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "base_failed": base,
        "n_lines": n_lines,
        "n_failed_lines": n_failed,
        "words_kept": words_kept,
        "kept": not base and 100 * (n_words - words_kept) <= rules["max_lost"] * n_words,
        "cleaned": "\n".join(kept_lines),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "words_kept")


def assess(documents: DataFrame, *, with_text: bool = False, rules: dict | None = None) -> DataFrame:
    """The documents' columns but ``text``, then counts, ``base_failed`` and ``kept``; with ``with_text`` also ``text`` and ``cleaned``.

    Every row is judged by its whole text: null and empty texts have no words
    and fail, repeated rows are judged alike, an empty table gives no rows.
    Input columns that have a result column's name are left out.
    """
    limits = DEFAULTS | (rules or {})
    results = {*COUNTS, "base_failed", "kept", "cleaned"}
    carried = [f for f in documents.schema if f.name not in results and (with_text or f.name != "text")]
    schema = T.StructType([*carried, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), *([T.StructField("cleaned", T.StringType())] if with_text else [])])
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds the cleaned texts held at once
                part = batch.slice(at, 512)
                found = [judge(t, limits) for t in part.column("text").to_pylist()]
                out = [part.column(c) for c in names]
                out += [pa.array([x[c] for x in found], pa.int64()) for c in COUNTS]
                out += [pa.array([x[c] for x in found], pa.bool_()) for c in ("base_failed", "kept")]
                out += [pa.array([x["cleaned"] for x in found], pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays(out, [f.name for f in schema])

    needed = documents.select(*names, *([] if with_text else ["text"]))
    return needed.mapInArrow(run, schema)


def clean(documents: DataFrame, *, rules: dict | None = None) -> DataFrame:
    """The kept documents with their failed lines removed; same columns, those with a result column's name included."""
    own = {c: f"_own_{i}" for i, c in enumerate(documents.columns) if c != "text"}
    judged = assess(documents.withColumnsRenamed(own), with_text=True, rules=rules).where("kept")
    return judged.select(*[judged["cleaned"].alias("text") if c == "text" else judged[own[c]].alias(c) for c in documents.columns])
