"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what every
match must contain, as trigrams joined by AND and OR. Each shard of documents (the Arrow
pieces of a task) gets an inverted index of the trigrams that the queries name; a rule's
postings are intersected and united as its query says, and only those candidates are
verified with the expression itself. Rules without a mandatory trigram, such as long hex
runs, scan every text. Texts are whole and the index only ever leaves out documents that
cannot match.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._arrow import text_slices, texts_of
from quern.session import ship_package


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost, non-overlapping matches; those whose ``group`` has
    fewer than ``least`` characters are then dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False

    def spans(self, text: str) -> list[tuple[int, int]]:
        """The matches' places. ``_LINEAR`` has a way for expressions that a backtracking
        engine would try again from each letter of a long run."""
        if self.pattern in _LINEAR:
            return _LINEAR[self.pattern](text)
        found = _compiled(self.pattern).finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


#: The base rules, in their order. A run of hex digits of 32 or more is found directly:
#: shorter runs would be dropped, and two runs never touch.
BASE_RULES = (
    Rule(
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2,
        least=8,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
)
#: Further shapes of credentials; they add spans and change nothing about the base.
_WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
_URL_PASSWORD = r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@"
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", _WEB_TOKEN),
    Rule("prefixed_token", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})"),
    Rule("url_password", _URL_PASSWORD),
)
RULES = BASE_RULES + MORE_RULES


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


def _web_tokens(text: str) -> list[tuple[int, int]]:
    """Matches of ``_WEB_TOKEN``, each run of token characters tried once: if the leftmost
    ``eyJ`` of a run fails, the run is too short behind it or goes on wrongly, and so is it
    for all others of the run."""
    run, rest = _compiled(r"[A-Za-z0-9_-]*"), _compiled(r"(?:\.[A-Za-z0-9_-]{8,}){2}")
    out, at = [], text.find("eyJ")
    while at >= 0:
        end = run.match(text, at).end()
        found = rest.match(text, end) if end - at >= 11 else None
        if found:
            out.append((at, found.end()))
            end = found.end()
        at = text.find("eyJ", end)
    return out


def _url_passwords(text: str) -> list[tuple[int, int]]:
    """Matches of ``_URL_PASSWORD``, from each ``://`` back to the first letter of the run
    before it; a run cannot reach over the ``://`` before."""
    rest = _compiled(r"://[^\s/:@]+:[^\s/@]+@")
    out, low, at = [], 0, text.find("://")
    while at >= 0:
        found = rest.match(text, at)
        if found:
            before = text[low:at]
            run = before[len(before.rstrip("abcdefghijklmnopqrstuvwxyz0123456789+.-")) :]
            name = run.lstrip("0123456789+.-")
            if name:
                out.append((at - len(name), found.end()))
                at = found.end() - 3
        low = at + 3
        at = text.find("://", low)
    return out


_LINEAR = {_WEB_TOKEN: _web_tokens, _URL_PASSWORD: _url_passwords}


# --- trigram queries ---------------------------------------------------------------
# A query is True (anything may match), a trigram, ("and", parts) or ("or", parts).

_MOST_STRINGS = 64


def _both(*queries):
    parts = []
    for q in queries:
        if q is not True and q not in parts:
            parts.append(q)
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _either(queries):
    parts = list(dict.fromkeys(queries))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]):
    """What one of these literal strings forces."""
    if not strings or any(len(s) < 3 for s in strings):
        return True
    return _either(_both(*(s[k : k + 3] for k in range(len(s) - 2))) for s in sorted(strings))


def _characters(items) -> set[str] | None:
    """The lower-cased characters of a small set, else None."""
    out: set[str] = set()
    for op, value in items:
        if op is K.LITERAL:
            out.add(chr(value).lower())
        elif op is K.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(parsed) -> tuple[set[str] | None, object]:
    """(the strings that the expression can be, or None; what it forces)."""
    now: set[str] = {""}
    exact, forced = True, True

    def unknown() -> None:
        nonlocal now, exact, forced
        forced, now, exact = _both(forced, _of_strings(now)), {""}, False

    def then(strings: set[str]) -> None:
        nonlocal now
        if len(now) * len(strings) > _MOST_STRINGS:
            unknown()
        now = {a + b for a in now for b in strings}

    for op, value in parsed:
        if op is K.LITERAL:
            then({chr(value).lower()})
        elif op is K.IN:
            found = _characters(value)
            if found is None:
                unknown()
            else:
                then(found)
        elif op is K.AT:
            continue
        elif op is K.SUBPATTERN or op is K.BRANCH or op in (K.MAX_REPEAT, K.MIN_REPEAT):
            if op is K.SUBPATTERN:
                strings, query = _walk(value[-1])
            elif op is K.BRANCH:
                ways = [_walk(x) for x in value[1]]
                exact_ways = all(s is not None for s, _ in ways)
                strings = set().union(*(s for s, _ in ways)) if exact_ways else None
                query = _either([q if s is None else _both(q, _of_strings(s)) for s, q in ways])
            else:
                low, high, body = value
                strings, query = _walk(body)
                if low == 0:
                    query = True
                    strings = strings | {""} if strings is not None and high == 1 else None
                elif not (low == high == 1):
                    if strings is not None:
                        then(strings)
                        if high == low and low <= 4:
                            for _ in range(low - 1):
                                then(strings)
                            continue
                    else:
                        forced = _both(forced, query)
                    unknown()
                    continue
            if strings is None:
                unknown()
                forced = _both(forced, query)
            else:
                then(strings)
        else:
            unknown()
    return (now, forced) if exact else (None, _both(forced, _of_strings(now)))


def trigram_query(pattern: str):
    """The Boolean trigram query (lower case) of what every match contains.

    Characters outside ASCII force nothing here, as the index is over bytes.
    """
    strings, query = _walk(_parser.parse(pattern, re.ASCII))
    if strings is not None:
        query = _both(query, _of_strings(strings))
    return True if any(not t.isascii() for t in trigrams_of(query)) else query


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


# --- the index ---------------------------------------------------------------------

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class TrigramIndex:
    """Postings of the given trigrams in a shard of texts."""

    _tables: dict[frozenset, tuple[list[str], np.ndarray]] = {}

    def __init__(self, texts: list[bytes], trigrams: frozenset[str]):
        if trigrams not in self._tables:
            names = sorted(trigrams)
            table = np.zeros(1 << 24, np.uint8 if len(names) < 255 else np.uint16)
            for k, name in enumerate(names):
                a, b, c = name.encode("ascii")
                table[a << 16 | b << 8 | c] = k + 1
            self._tables[trigrams] = names, table
        names, table = self._tables[trigrams]
        self.all = np.arange(len(texts))
        joined = np.frombuffer(b"\0\0".join(texts).translate(_LOWER) + b"\0\0\0", np.uint8)
        ends = np.cumsum([len(t) + 2 for t in texts])
        seen = []
        for start in range(0, len(joined) - 2, 1 << 22):
            part = joined[start : start + (1 << 22) + 2].astype(np.uint32)
            which = table[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            at = np.flatnonzero(which)
            docs = np.searchsorted(ends, at + start, "right")
            seen.append(np.unique(docs * (len(names) + 1) + which[at]))
        pairs = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        docs, which = pairs // (len(names) + 1), pairs % (len(names) + 1)
        order = np.argsort(which, kind="stable")
        cut = np.searchsorted(which[order], np.arange(1, len(names) + 2))
        self.postings = {name: docs[order][cut[k] : cut[k + 1]] for k, name in enumerate(names)}

    def find(self, query) -> np.ndarray:
        if query is True:
            return self.all
        if isinstance(query, str):
            return self.postings[query]
        found = [self.find(q) for q in query[1]]
        merge = np.intersect1d if query[0] == "and" else np.union1d
        out = found[0]
        for other in found[1:]:
            out = merge(out, other)
        return out


def scanner(rules: tuple[Rule, ...]) -> Callable[[list[str]], list[list[tuple[int, int, int]]]]:
    """A function from a shard's texts to each text's (start, rule number, end), sorted."""
    queries = [trigram_query(rule.pattern) for rule in rules]
    wanted = frozenset().union(*map(trigrams_of, queries))

    def scan(texts: list[str]) -> list[list[tuple[int, int, int]]]:
        index = TrigramIndex([t.encode("utf-8") for t in texts], wanted)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (rule, query) in enumerate(zip(rules, queries)):
            for k in index.find(query).tolist():
                out[k] += [(start, number, end) for start, end in rule.spans(texts[k])]
        for spans in out:
            spans.sort()
        return out

    return scan


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """``id, spans array<struct<kind, start, stop, base>>`` per row, by start and then
    by the rules' order; places in code points, ends exclusive.

    One map without a shuffle. Null and empty texts have no spans; repeated rows and
    null ids pass through; an empty table gives an empty table; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())])

    def find(batches):
        scan = scanner(rules)
        for batch in text_slices(batches, 1):
            found = [
                [(rules[n].kind, a, b, rules[n].base) for a, n, b in spans]
                for spans in scan(texts_of(batch.column(1)))
            ]
            rows = [[dict(zip(("kind", "start", "stop", "base"), s)) for s in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], ["_id", "spans"])

    schema = f"_id {kind}, spans array<struct<kind:string,start:bigint,stop:bigint,base:boolean>>"
    return rows.mapInArrow(find, schema).withColumnRenamed("_id", id_col)


def span_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds and the spans as text, from ``scan_secrets``' rows."""
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        id_col,
        *(count(rule.kind) for rule in BASE_RULES),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
