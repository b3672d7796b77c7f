"""Operator 12: secret scan with one combined deterministic automaton.

All rules' regexes are compiled into one minimal automaton (``automaton.py``) that reads every byte
once, for all rules together, and says after each byte which rules have a match that could end there.
Where it is back in its start no match is under way, so every match begins in a stretch between two
such places in which its rule could end. Only these stretches are looked at again, by that rule's
own automaton: matches are taken leftmost first, as long as possible, without overlaps.

The scan runs over many places of a chunk side by side: a byte behind which the automaton is in
its start, whatever came before (a line feed, a comma, any byte beyond ASCII), separates.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton
from .common import bound_batches, chunks, utf8

LANE = 256                   # bytes after which the next separating byte begins a new lane
FEW_LANES = 24               # lanes fewer than this are read one by one
WINDOW = 1 << 20             # bytes of a long text read at once
_CONTINUES = np.arange(256) & 0xC0 == 0x80


class Rule(NamedTuple):
    """``kind`` and regex; of its matches those stay that are ``least`` characters long and whose
    part from the first place on where the regex could have ended has ``tail`` characters."""
    kind: str
    pattern: str
    least: int = 1
    tail: int = 1


# The base rules, in the order their kinds are listed in. Runs of eight hex digits
# and more are asked for in the automaton; shorter ones could not stay.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", tail=12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{8,}", least=16),
)
# Rules beyond the base ones: published formats of issued credentials
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("private_key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"),
    Rule("url_login", r"://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+-]+@", least=8),
)
RULES = BASE + EXTRA


class Scanner:
    """The combined automaton of the rules and one anchored automaton for each."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        both = Automaton([r.pattern for r in rules], anchored=False)
        self.single = [Automaton([r.pattern], anchored=True) for r in rules]
        for r, a in zip(rules, self.single):
            if (a.table[1:] == a.start).any():
                raise ValueError(f"rule {r.kind} begins with a part that may be left out any number of times")
        self.accepts = both.accepts
        self.any = both.accepts.any(axis=1)
        n = both.table.shape[1]
        self.flat = (both.table.astype(np.int32) * n).reshape(-1)      # next state, times the classes
        self.width = n
        self.classes = both.classes.astype(np.int32)
        self.separates = (both.table == both.start).all(axis=0)[both.classes]
        for a in self.single:                              # nor may a longer match run over it
            self.separates &= (a.table == 0).all(axis=0)[a.classes]
        self.start = both.start * n
        if both.start or not self.separates[10]:
            raise ValueError("a rule can run past a line feed")
        self.next_state = self.flat.tolist()

    def states(self, b: np.ndarray) -> np.ndarray:
        """State (times ``width``) behind every byte; ``b`` is read from the start state."""
        cls = self.classes[b]
        out = np.zeros(len(b), dtype=np.int32)
        ends = np.flatnonzero(self.separates[b]) + 1
        pick = np.searchsorted(ends, np.arange(LANE, len(b), LANE))
        begin = np.unique(np.concatenate(([0], ends[np.unique(pick[pick < len(ends)])])))
        begin = begin[begin < len(b)]
        size = np.diff(begin, append=len(b))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        state = np.full(len(begin), self.start, dtype=np.int32)
        j = 0
        while j < len(active) and active[j] >= FEW_LANES:
            m = active[j]
            at = begin[:m] + j
            state[:m] = self.flat[state[:m] + cls[at]]
            out[at] = state[:m]
            j += 1
        nxt = self.next_state
        for i in range(active[j] if j < len(active) else 0):
            lo, hi, s = begin[i] + j, begin[i] + size[i], int(state[i])
            seen = []
            for c in cls[lo:hi].tolist():
                s = nxt[s + c]
                seen.append(s)
            out[lo:hi] = seen
        return out

    def spans(self, data: bytes):
        """(rule number, start, end) of all matches that stay in ``data``, in bytes."""
        state = self.states(np.frombuffer(data, dtype=np.uint8)) // self.width
        hits = np.flatnonzero(self.any[state])
        if not len(hits):
            return []
        rest = np.flatnonzero(state == 0)
        where = np.searchsorted(rest, hits)
        new = np.flatnonzero(np.diff(where, prepend=-1))
        could = np.logical_or.reduceat(self.accepts[state[hits]], new, axis=0)
        found = []
        done = [0] * len(self.rules)
        for i, w in enumerate(where[new].tolist()):
            lo = int(rest[w - 1]) + 1 if w else 0
            hi = int(rest[w]) if w < len(rest) else len(data)
            for r in np.flatnonzero(could[i]).tolist():
                rule, auto, at = self.rules[r], self.single[r], max(lo, done[r])
                while at < hi:
                    first, last = auto.longest(data, at)
                    if last < 0:
                        at += 1
                        continue
                    if last - at >= rule.least and last - first + 1 >= rule.tail:
                        found.append((r, at, last))
                    done[r] = at = last
        return found


def _windows(sc: Scanner, text: bytes, most: int = WINDOW):
    """(offset, part) of a text; parts end behind a separating byte, so no match is cut."""
    lo = 0
    while lo < len(text):
        hi = min(lo + most, len(text))
        step = 4096
        while hi < len(text):
            ends = np.flatnonzero(sc.separates[np.frombuffer(text[hi - 1:hi - 1 + step], dtype=np.uint8)])
            if len(ends):
                hi += int(ends[0])
                break
            hi, step = min(hi + step, len(text)), step * 2
        yield lo, text[lo:hi] if lo or hi < len(text) else text
        lo = hi


def _find(sc: Scanner, texts: list[bytes]):
    """Per text its (rule, start, end), in code points, by start, then rule."""
    out: list[list] = [[] for _ in texts]
    for lo, hi in chunks(map(len, texts)):
        if hi - lo == 1:
            for off, part in _windows(sc, texts[lo]):
                out[lo].extend((off + s, r, off + e) for r, s, e in sc.spans(part))
            continue
        at = np.cumsum([0, *(len(t) + 1 for t in texts[lo:hi])])
        for r, s, e in sc.spans(b"\n".join(texts[lo:hi])):
            i = int(np.searchsorted(at, s, side="right")) - 1
            out[lo + i].append((int(s - at[i]), r, int(e - at[i])))
    for i, found in enumerate(out):
        if found:
            b = texts[i]
            if not b.isascii():
                head = np.cumsum(~_CONTINUES[np.frombuffer(b, dtype=np.uint8)], dtype=np.int64)
                found = [(int(head[s]) - 1, r, int(head[e - 1])) for s, r, e in found]
            out[i] = [(r, s, e) for s, r, e in sorted(found)]
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanning(scanner, rules: tuple[Rule, ...]):  # noqa: ANN001
    def run(batches):
        sc: Scanner = scanner.value
        for b in batches:
            found = _find(sc, utf8(b.column(1)))
            rows = [[{"kind": rules[r].kind, "start": s, "end": e} for r, s, e in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _SPANS)], ["doc_id", "spans"])
    return run


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): per row of ``docs`` the matches of all rules in its whole text, as (kind,
    start, end) in code points, end exclusive, by start, then by the rules' order.

    Matches of one rule are leftmost, as long as possible and do not overlap; matches of different
    rules may. A match that a rule's lengths drop still covers its place. A null text is an empty
    one and has no spans, as has a text without a match; rows that repeat an id are judged each.
    Other columns are left out, whatever their names; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))       # its size depends on the rules alone
    return src.mapInArrow(_scanning(scanner, rules), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def masked(text: str = "text", spans: str = "spans") -> F.Column:
    """The text with every span written as ``[kind]``; of spans that overlap the first counts."""
    put = F.aggregate(
        F.col(spans), F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], F.col(text).substr((acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")),
                     F.lit("["), x["kind"], F.lit("]")).alias("out"), x["end"].alias("at"))))
    return F.concat(put["out"], F.col(text).substr((put["at"] + 1).cast("int"), F.length(F.col(text))))
