"""Secret scans by a trigram index: Boolean trigram queries from each rule's regular expression, then verification.

A rule's expression is parsed and turned into a Boolean query over lower-case trigrams that every match must contain,
as AND and OR of literal runs. Each block of texts is indexed once for the trigrams that any rule asks for, whatever the
number of rules; postings are intersected and united as the query says, and only the texts left are searched by the
expression itself. A rule without mandatory trigrams, such as a plain run of hexadecimal digits, scans every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwell.llm.blocks import text_blocks


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost matches; those with fewer than ``least`` characters in ``group`` are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False


#: A line break, as it stands or escaped, and what may stand in the key lines below the line that begins a private key.
_BREAK = r"(?:[\x20\t]*+(?:[\r\n]|\\r|\\n))++[\x20\t]*+"
_KEY_LINE = (
    rf"{_BREAK}(?:Proc-Type|DEK-Info|Version|Comment|MessageID|Hash|Charset):(?:(?!-----BEGIN )[^\r\n\\])*+"
    rf"|{_BREAK}[A-Za-z0-9+/=]++(?=[\x20\t]*+(?:[\r\n\\\"']|\Z))"
    rf"|(?:{_BREAK}|[\x20\t]*+)[A-Za-z0-9+/=]{{16,}}+"
)
_KEY_NAME = r"(?:[A-Z0-9]++\x20)*PRIVATE KEY(?: BLOCK)?-----"

# The kinds that every scan reports, in their order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Rules that the scan adds.
MORE_RULES = (
    # to its END line; where that is missing, or another block begins before it, to the end of the key lines
    Rule("private_key", rf"-----BEGIN {_KEY_NAME}(?:(?s:(?!-----BEGIN ).)*?-----END {_KEY_NAME}|(?:{_KEY_LINE})*+)"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("repo_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"(?<![A-Za-z0-9])[A-Za-z0-9]++://[^\x00-\x20:@/]*+:[^\x00-\x20@/]++@"),
    Rule("bearer", r"bearer\x20+([A-Za-z0-9._~+/-]{20,}=*)", any_case=True),
)
RULES = BASE_RULES + MORE_RULES

#: ("all", parts), ("any", parts), a trigram, or None where nothing is asked for.
Query = tuple | str | None


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("all", tuple(parts))


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("any", tuple(parts))


def _trigrams(text: str) -> Query:
    raw = text.lower().encode()
    return _all([raw[i : i + 3].decode("latin-1") for i in range(len(raw) - 2)])


def _strings(node) -> list[str] | None:
    """All strings that a small piece of an expression can match, or None where they are too many."""
    op, arg = node
    if op is C.LITERAL:
        return [chr(arg)]
    if op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
        return [chr(a) for _, a in arg]
    if op is C.BRANCH:
        parts = [_sequence_strings(p) for p in arg[1]]
        return None if None in parts else [s for p in parts for s in p]
    if op is C.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 3:
        inner = _sequence_strings(arg[2])
        if inner is None:
            return None
        out, now = [], [""]
        for i in range(arg[1] + 1):
            if i >= arg[0]:
                out += now
            now = [a + b for a in now for b in inner]
        return list(dict.fromkeys(out))
    return None


def _sequence_strings(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        more = _strings(node)
        if more is None:
            return None
        out = [a + b for a in out for b in more]
        if len(out) > 64:
            return None
    return out


def trigram_query(nodes) -> Query:
    """What every match of a parsed expression must contain."""
    asked: list[Query] = []
    run = [""]  # all strings of the literal run so far

    def close() -> None:
        nonlocal run
        asked.append(_any([_trigrams(s) for s in run]))
        run = [""]

    for node in nodes:
        strings = _strings(node)
        if strings is not None and len(run) * len(strings) <= 64:
            run = [a + b for a in run for b in strings]
            continue
        close()
        op, arg = node
        if strings is not None:
            run = strings
        elif op is C.SUBPATTERN:
            asked.append(trigram_query(arg[3]))
        elif op is C.BRANCH:
            asked.append(_any([trigram_query(p) for p in arg[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            asked.append(trigram_query(arg[2]))
    close()
    return _all(asked)


def rule_query(rule: Rule) -> Query:
    return trigram_query(_parser.parse(rule.pattern))


def _leaves(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_leaves, query[1]))


@lru_cache(maxsize=8)
def _compiled(rules: tuple[Rule, ...]):
    """Expressions, queries, and the number of each trigram asked for in a table over all three-byte codes."""
    queries = [rule_query(r) for r in rules]
    grams = sorted(set().union(*map(_leaves, queries)))
    number = np.zeros(1 << 24, dtype=np.int16)
    for i, g in enumerate(grams):
        a, b, c = g.encode("latin-1")
        number[a << 16 | b << 8 | c] = i + 1
    return [re.compile(r.pattern, re.ASCII | re.IGNORECASE * r.any_case) for r in rules], queries, grams, number


def _postings(texts: pa.StringArray, grams: list[str], number: np.ndarray) -> dict[str, np.ndarray]:
    """For each trigram, which of the texts hold it, in any case of A-Z."""
    low = pc.ascii_lower(texts)
    at = np.frombuffer(low.buffers()[1], dtype=np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    data = np.frombuffer(low.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]].astype(np.int32)
    code = number[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]] if len(data) > 2 else np.zeros(0, np.int16)
    place = np.flatnonzero(code)
    row = np.searchsorted(at - at[0], place, side="right") - 1
    inside = place + 2 < (at - at[0])[row + 1]  # not across two texts
    seen = np.unique(code[place[inside]].astype(np.int64) * len(texts) + row[inside])
    ends = np.searchsorted(seen, np.arange(1, len(grams) + 2) * len(texts))
    return {g: seen[ends[i] : ends[i + 1]] % len(texts) for i, g in enumerate(grams)}


def _rows(query: Query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    if query is None:
        return np.arange(n)
    if isinstance(query, str):
        return postings[query]
    parts = [_rows(q, postings, n) for q in query[1]]
    if query[0] == "any":
        return np.unique(np.concatenate(parts))
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True)
    return out


def find_spans(texts: pa.StringArray, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """(start, end, number of the rule) in code points for each text, sorted."""
    patterns, queries, grams, number = _compiled(rules)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    postings = _postings(texts, grams, number)
    for k, (rule, pattern, query) in enumerate(zip(rules, patterns, queries)):
        rows = _rows(query, postings, len(texts))
        if query is None:  # a full scan; the vectorized search only says which texts have a match at all
            size = f"{{{rule.least}}}" if rule.least and rule.pattern.endswith("]+") else ""
            try:
                hit = pc.match_substring_regex(texts, rule.pattern[:-1] + size if size else rule.pattern, ignore_case=rule.any_case)
                rows = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
            except pa.ArrowInvalid:  # an expression that only ``re`` knows: it looks at every text itself
                pass
        for i in rows.tolist():
            out[i] += [(m.start(), m.end(), k) for m in pattern.finditer(texts[i].as_py()) if len(m[rule.group]) >= rule.least]
    return [sorted(x, key=lambda s: (s[0], s[2])) for x in out]


def scan_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` (doc_id, text, ...) to (doc_id, spans: array of kind, start, end in code points, end exclusive), a row each.

    Matches are leftmost and do not overlap within a kind; spans are sorted by start, then by the order of the rules.
    Null and empty texts have no spans, and texts of any length are searched whole. Repeated rows give repeated rows; other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            texts = pc.fill_null(batch.column("text"), "")
            found = [[{"kind": rules[k].kind, "start": s, "end": e} for s, e, k in x] for x in find_spans(texts, rules)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with every secret in ``text`` replaced by ``[kind]``; overlapping spans become one, of the first kind.

    All columns and rows stay; a changed text has a new ``n_chars`` where there is such a column. Null texts stay null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            texts = batch.column("text")
            found = find_spans(pc.fill_null(texts, ""), rules)
            if any(found):
                new, sizes = texts.to_pylist(), batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else None
                for i, spans in enumerate(found):
                    if spans:
                        pieces, at, last = [], 0, -1
                        for s, e, k in spans:
                            if s >= last:
                                pieces += [new[i][at:s], f"[{rules[k].kind}]"]
                            at = last = max(last, e)
                        new[i] = "".join([*pieces, new[i][at:]])
                        if sizes is not None:
                            sizes[i] = len(new[i])
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, texts.type))
                if sizes is not None:
                    batch = batch.set_column(batch.schema.get_field_index("n_chars"), "n_chars", pa.array(sizes, batch.schema.field("n_chars").type))
            yield batch

    return df.mapInArrow(run, df.schema)
