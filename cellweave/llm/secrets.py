"""Secret scans: fixed patterns, then formats learned by grammar inference.

Credentials that the base patterns find in all documents are the labelled examples.
For each kind a prefix-tree automaton of their character classes is built, and states whose
outgoing frequencies are statistically compatible (Hoeffding bounds on every transition and on
ending, recursively, and on the distribution of the length that is left) are merged, which leaves a
probabilistic automaton. States of one depth are tried first; states of different depths are merged
only on evidence, ``LOOP`` examples through each, and have lengths left that agree: so a format of
fixed length is a chain, with its letters by place, and one of free length has loops. Every other candidate
string, anywhere in a text, is scored whole by its likelihood per character under each automaton; it
is a secret if it is at least as likely as all but ``MISSED`` of the automaton's own examples.
Candidates are what base spans leave of the runs of credential characters, and their parts between
``=``, ``.`` and ``/``; those as short as the shortest example of a kind are tried for it, with a
digit or a letter where its examples always have one. Of overlapping secrets the longest counts.

Of each kind's different examples the ``EXAMPLES`` of least hash are used, up to ``TREE`` characters,
so the bound is on labelled strings and a rare kind keeps its own at every size of table. They are
picked by partition, then by ``SALTS`` parts of the hashes, then as a whole. All documents are
scanned, whole.

Defined cases: null text is empty; a kind with under ``LEAST_EXAMPLES`` different examples in the
whole table has no automaton and the method adds nothing for it; repeated rows and equal strings are
one example; doc_ids may be of any type and are not read; other columns are ignored; an empty table
gives no rows; texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import table

EXAMPLES = 300
LEAST_EXAMPLES = 10
SALTS = 64
#: Characters of a kind's examples, which the driver holds as a prefix tree.
TREE = 500_000
CONFIDENCE = 0.05
#: Examples through each of two states of different depths that may be merged.
LOOP = 30
MISSED = 0.02
#: Probability of a character class that a state never showed.
UNSEEN = 1e-9
UNSEEN_LOG = math.log(UNSEEN)

KINDS = ("assign", "access", "hex")
#: The base patterns of the contract (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
SIGNS = re.compile(r"[./]+|=+")
HAS_DIGIT = re.compile("[0-9]")
HAS_LETTER = re.compile("[A-Za-z]")
WORDS = ("password", "passwd", "secret", "token", "api")
_HEX_MAP = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_MAP):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def shape(s: str) -> str:
    """Character classes: 0 digit, h a-f, l other lower case, H A-F, U other upper case; signs are themselves."""
    return "".join(
        "0" if c.isdigit() else ("h" if c < "g" else "l") if c.islower() else ("H" if c < "G" else "U") if c.isupper() else c
        for c in s
    )


class Automaton:
    """Probabilistic automaton inferred from strings by merging compatible states of their prefix tree."""

    def __init__(self, strings: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.depth = [0]
        #: How often each length is left.
        self.left: list[dict[int, int]] = [{}]
        for s in strings:
            q = 0
            for i, c in enumerate(s):
                self._leave(q, len(s) - i, 1)
                self.seen[q][c] = self.seen[q].get(c, 0) + 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.seen.append({})
                    self.ends.append(0)
                    self.depth.append(i + 1)
                    self.left.append({})
                q = self.next[q][c]
            self._leave(q, 0, 1)
            self.ends[q] += 1
        self._merge()
        self.logs: dict[int, dict[str, float]] = {}

    def _leave(self, q: int, length: int, n: int) -> None:
        self.left[q][length] = self.left[q].get(length, 0) + n

    @staticmethod
    def _bound(n: int, m: int) -> float:
        return math.sqrt(0.5 * math.log(2 / CONFIDENCE)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _same_lengths(self, a: int, b: int) -> bool:
        """Whether the distributions of the length left differ by no more than chance."""
        n, m = self._total(a), self._total(b)
        bound, apart = self._bound(n, m), 0.0
        for x in sorted(self.left[a].keys() | self.left[b].keys()):
            apart += self.left[a].get(x, 0) / n - self.left[b].get(x, 0) / m
            if abs(apart) > bound:
                return False
        return True

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.seen[q].values())

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no frequency of two states, or of states they lead to alike, differs by more than chance."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            bound = self._bound(n, m)
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for c in self.seen[a].keys() | self.seen[b].keys():
                if abs(self.seen[a].get(c, 0) / n - self.seen[b].get(c, 0) / m) > bound:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    stack.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        stack = [(into, tree)]
        while stack:
            a, b = stack.pop()
            self.ends[a] += self.ends[b]
            for x, n in self.left[b].items():
                self._leave(a, x, n)
            for c, n in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + n
                if c in self.next[a]:
                    stack.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _home(self, red: list[int], q: int) -> int | None:
        """The state that a state is merged into: of its own depth, or else of any, on evidence."""
        n = self._total(q)
        for own in (True, False):
            for r in red:
                if own != (self.depth[r] == self.depth[q]) or not own and min(n, self._total(r)) < LOOP:
                    continue
                if self._same_lengths(r, q) and self._compatible(r, q):
                    return r
        return None

    def _merge(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            # The most travelled first, so that rare states meet those that have evidence.
            parent, c = max(blue, key=lambda b: (-self.depth[self.next[b[0]][b[1]]], self._total(self.next[b[0]][b[1]]), b))
            q = self.next[parent][c]
            if (r := self._home(red, q)) is not None:
                self.next[parent][c] = r
                self._fold(r, q)
            else:
                red.append(q)
            known = set(red)
            blue = [(r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in known]
        names = {q: i for i, q in enumerate(red)}
        self.next, self.seen, self.ends = (
            [{c: names[t] for c, t in self.next[q].items()} for q in red],
            [self.seen[q] for q in red],
            [self.ends[q] for q in red],
        )
        del self.depth, self.left

    def likelihood(self, s: str, least: float = -math.inf) -> float:
        """Mean log probability a character, the end included; less than ``least`` as soon as it cannot reach it."""
        q, log, low = 0, 0.0, least * (len(s) + 1) - 1e-9
        for c in s:
            known = self._logs(q)
            log += known.get(c, UNSEEN_LOG)
            if log < low:
                return -math.inf
            q = self.next[q].get(c, q)
        return (log + self._logs(q).get("", UNSEEN_LOG)) / (len(s) + 1)

    def _logs(self, q: int) -> dict[str, float]:
        """Log probabilities of a state's characters and, as the empty string, of ending."""
        if (known := self.logs.get(q)) is None:
            n = self._total(q)
            known = {c: math.log(max(k / n, UNSEEN)) for c, k in [*self.seen[q].items(), ("", self.ends[q])] if n and k}
            self.logs[q] = known
        return known


class Grammar:
    """Automata, least likelihoods and what all examples have, by kind."""

    def __init__(self, examples: dict[str, list[str]]):
        self.automata = {}
        self.needs = {}
        for kind, strings in examples.items():
            if len(strings) < LEAST_EXAMPLES:
                continue
            shapes = [shape(s) for s in strings]
            automaton = Automaton(shapes)
            own = sorted(map(automaton.likelihood, shapes))
            self.automata[kind] = automaton, own[int(MISSED * len(own))]
            needs = [p for p in (HAS_DIGIT, HAS_LETTER) if all(p.search(s) for s in strings)]
            self.needs[kind] = min(map(len, strings)), max(map(len, strings)), needs
        self.shortest = min((n for n, _, _ in self.needs.values()), default=0)
        self.longest = max((n for _, n, _ in self.needs.values()), default=0)
        self.digits = all(HAS_DIGIT in needs for _, _, needs in self.needs.values())

    def likely(self, s: str) -> str | None:
        """The kind whose format a string has best, or None."""
        best = None
        form = None
        for kind, (automaton, least) in self.automata.items():
            shortest, _, needs = self.needs[kind]
            if len(s) < shortest or not all(p.search(s) for p in needs):
                continue
            form = form or shape(s)
            x = automaton.likelihood(form, least) - least
            if x >= 0 and (best is None or x > best[0]):
                best = x, kind
        return best and best[1]

    def _parts(self, s: str) -> list[tuple[int, int]]:
        """A run and its parts between signs, as long as examples are; longest first."""
        starts, ends = {0}, {len(s)}
        for m in SIGNS.finditer(s):
            starts.add(m.end())
            ends |= {m.start(), m.end()}
        order = sorted(ends)
        parts = {(0, len(s))} if len(s) >= self.shortest else set()
        for a in starts:
            for b in order[bisect_left(order, a + self.shortest) :]:
                if b - a > self.longest:
                    break
                parts.add((a, b))
        return sorted(parts, key=lambda p: (p[0] - p[1], p[0]))

    def _secrets(self, s: str) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        if len(s) < self.shortest or self.digits and not HAS_DIGIT.search(s):
            return found
        for a, b in self._parts(s):
            if all(b <= x or y <= a for x, y in found) and self.likely(s[a:b]):
                found.append((a, b))
        return sorted(found)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
        """Candidates beside the base spans that have a learned format."""
        if not self.automata or self.digits and not HAS_DIGIT.search(text):
            return []
        found = []
        at = 0
        for start, end in [*((a, e) for a, _, e in base), (len(text), len(text))]:
            for m in CANDIDATE.finditer(text, at, max(start, at)):
                found += [(m.start() + a, "learned", m.start() + b) for a, b in self._secrets(m[0])]
            at = max(at, end)
        return found


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def labelled(docs: DataFrame) -> dict[str, list[str]]:
    """Examples of each kind; the driver gets at most EXAMPLES a kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[str]] = {0: [], 1: [], 2: []}
        for b in batches:
            new: dict[int, set[str]] = {k: set(v) for k, v in found.items()}
            for x in b.column(0):
                t = x.as_py()
                for start, kind, end in base_spans(t):
                    s = t[start:end]
                    new[kind].add(ASSIGN.match(s)[2] if kind == 0 else s)
            found = {k: sorted(v, key=_hash)[:EXAMPLES] if len(v) > len(found[k]) else found[k] for k, v in new.items()}
        rows = [(k, s, _hash(s)) for k, v in found.items() for s in v]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "s", "h"])

    rows = docs.where("text is not null").select("text").mapInArrow(run, "kind int, s string, h string").distinct()
    salt = F.pmod(F.xxhash64("h"), F.lit(SALTS))
    for by in (["kind", salt], ["kind"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("h", "s"))
        rows = rows.withColumn("r", rank).where(F.col("r") <= EXAMPLES).drop("r")
    found: dict[str, list[str]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.kind, r.h, r.s)):
        found.setdefault(KINDS[r.kind], []).append(r.s)
    return {k: _within(v) for k, v in found.items()}


def _within(strings: list[str]) -> list[str]:
    """The first strings of at most TREE characters."""
    return [s for s, n in zip(strings, accumulate(map(len, strings)), strict=True) if n <= TREE]


def _hash(s: str) -> str:
    return hashlib.md5(s.encode(), usedforsecurity=False).hexdigest()


def scanned(docs: DataFrame, grammar: Grammar) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                text = x.as_py() or ""
                base = base_spans(text)
                named = [(a, KINDS[k], e) for a, k, e in base]
                more = grammar.spans(text, base)
                counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                digest = hashlib.sha256(_joined(named).encode()).hexdigest()
                out.append((*counts, digest, _joined(sorted(named + more, key=lambda s: s[0])), len(more)))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([o[i] for o in out], t) for i, t in enumerate(types))], names=names
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long"
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scanned(docs, Grammar(labelled(docs)))
