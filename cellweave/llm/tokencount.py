"""Token counts of a byte-level BPE by prefix dynamic programming.

An encoding that ends in token t is the encoding of the text before t, followed by t, if and only
if the pair (token before t, t) is itself encoded as those two tokens. So one pass over a piece
finds, for every prefix, its last token and its count: count[j] = count[i] + 1. Pieces are what the
tokenizer's pattern cuts; a text's counts are running sums over its pieces. The counts of all
prefixes are kept, so a truncation or budget question (``fit_chars``: how much of a text a limit
holds) looks them up and encodes nothing again, but for a cut in white space or in a contraction,
where a prefix is cut into other pieces than the text: then that white space or contraction alone.

Pieces' counts are kept in a cache of ``CACHE`` entries a worker; prefix counts of pieces of one
token are not kept, as none of their prefixes has fewer. Characters that this library's
pattern engine classes differently from the tokenizer's are found by asking the tokenizer once a
character; texts with one are cut by the tokenizer's own pattern.

Defined cases: null text is empty and has 0 tokens; the tokenizer's added tokens inside a text
count as one token each, as is its default, and no cut falls inside one; repeated rows are counted
each; doc_ids may be of any type; other columns, of any name, are ignored; an empty table gives no
rows; memory for a long text is its pieces'.
"""

from __future__ import annotations

import bisect
import itertools
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellweave.llm.common import table

LIMIT = 512
CACHE = 1_000_000
#: The split that byte-level BPE of this family makes before merging (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 is itself, the rest follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counts(dict):
    """piece -> its number of tokens, filled on demand."""

    def __init__(self, bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
            self.bpe.kept.clear()
        counts = self.bpe.prefix_counts(piece.encode("utf-8", "surrogatepass"))
        n = self[piece] = counts[-1]
        if n > 1:
            self.bpe.kept[piece] = array("i", counts)
        return n


class PrefixBpe:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        # Tokens by order of making: the single bytes, then what each merge makes. A merge that makes
        # a token anew has no number of its own; only the first can be met.
        self.number = {bytes([b]): b for b in range(256)}
        self.halves = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in self.ranks:
            if a in self.number and b in self.number and a + b not in self.number:
                self.number[a + b] = self.joined[self.number[a], self.number[b]] = len(self.halves)
                self.halves.append((self.number[a], self.number[b]))
        self.longest = max(map(len, self.number))
        self.own: dict[bytes, bool] = {}
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.tokenizer = Tokenizer.from_file(path)
        self.counts = Counts(self)
        #: Counts of all prefixes of pieces of several tokens.
        self.kept: dict[str, array] = {}
        self.same: set[str] = set(map(chr, range(128)))
        self.other: set[str] = set()
        self._pairs: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """Encoding by the merge rules alone, lowest rank first and leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(itertools.pairwise(parts)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _alone(self, token: bytes) -> bool:
        """Whether a token's bytes are encoded as that token."""
        ok = self.own.get(token)
        if ok is None:
            ok = self.own[token] = self.merge(token) == [token]
        return ok

    def _apart(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens stay two: no merge across their border comes before what made them.

        The merges that made both are undone, latest first; at each step the tokens that then meet at
        the border must not have a merge that is earlier than the one undone.
        """
        before = len(self.halves) + 1
        while True:
            made = self.joined.get((a, b))
            if made is not None and made < before:
                return False
            if a > b and a >= 256:
                before, a = a, self.halves[a][1]
            elif b >= 256:
                before, b = b + 1, self.halves[b][0]
            elif a >= 256:
                before, a = a, self.halves[a][1]
            else:
                return True

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of every prefix of one piece, 0 for the empty one first."""
        count, last = [0], [-1]
        number, known = self.number, self._pairs
        for j in range(1, len(piece) + 1):
            for i in range(max(0, j - self.longest), j):
                t = number.get(piece[i:j])
                if t is None:
                    continue
                if i == 0:
                    ok = self._alone(piece[:j])
                else:
                    ok = known.get((last[i], t))
                    if ok is None:
                        if len(known) >= CACHE:
                            known.clear()
                        ok = known[last[i], t] = self._apart(last[i], t)
                if ok:
                    count.append(count[i] + 1)
                    last.append(t)
                    break
            else:
                raise ValueError("no token ends here")
        return count

    def pieces(self, text: str) -> list[str]:
        """What the tokenizer's pattern cuts a text without added tokens into."""
        for c in set(text) - self.same:
            if c not in self.other:
                probe = f"a{c}1 {c}{c}?"
                (self.same if self._asked(probe) == self.pattern.findall(probe) else self.other).add(c)
        return self._asked(text) if self.other and not self.other.isdisjoint(text) else self.pattern.findall(text)

    def _asked(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is an added token, string) in order."""
        if self.split is None or not any(a in text for a in self.added):
            yield False, text
        else:
            for i, s in enumerate(self.split.split(text)):
                if s:
                    yield i % 2 == 1, s

    def count(self, text: str | None) -> int:
        return sum(1 if special else sum(map(self.counts.__getitem__, self.pieces(s))) for special, s in self.parts(text or ""))

    def inside(self, piece: str, i: int) -> int:
        """Tokens of a piece's first characters."""
        if self.counts[piece] == 1:
            return min(i, 1) if i in (0, len(piece)) else self.prefix_counts(piece[:i].encode("utf-8", "surrogatepass"))[-1]
        counts = self.kept.get(piece)
        if counts is None:
            counts = self.prefix_counts(piece.encode("utf-8", "surrogatepass"))
        return counts[len(piece[:i].encode("utf-8", "surrogatepass"))]

    def fit(self, text: str | None, limit: int) -> tuple[int, int]:
        """(tokens of the text, characters of its longest prefix that has ``limit`` tokens at most)."""
        text = text or ""
        total, at, chars = 0, 0, None
        for special, s in self.parts(text):
            pieces = None if special else self.pieces(s)
            n = 1 if special else sum(map(self.counts.__getitem__, pieces))
            if chars is None and total + n > limit:
                chars = at + (0 if special else Prefixes(self, s, pieces, limit - total).longest(limit - total))
            total += n
            at += len(s)
        return total, len(text) if chars is None else chars

    def prefixes(self, text: str) -> Prefixes:
        return Prefixes(self, text)


#: Pieces of which a beginning is not one piece (fixed values of the pattern).
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))


class Prefixes:
    """Exact token counts of all prefixes of one text without added tokens; of those up to ``most`` tokens, if given."""

    def __init__(self, bpe: PrefixBpe, text: str, pieces: list[str] | None = None, most: int | None = None):
        self.bpe, self.text = bpe, text
        self.cut, self.ends, self.sums = [], [], []
        end = total = 0
        for p in bpe.pieces(text) if pieces is None else pieces:
            end += len(p)
            total += bpe.counts[p]
            self.cut.append(p)
            self.ends.append(end)
            self.sums.append(total)
            if most is not None and total > most:
                break

    def at(self, i: int) -> int:
        """Tokens of text[:i]."""
        if i <= 0:
            return 0
        k = bisect.bisect_left(self.ends, i)
        piece = self.cut[k]
        start, before = (self.ends[k - 1], self.sums[k - 1]) if k else (0, 0)
        if i == self.ends[k]:
            return self.sums[k]
        if not self.text[i - 1].isspace() and piece not in CONTRACTIONS:
            return before + self.bpe.inside(piece, i - start)
        # White space at the end of a text is one piece, whatever follows it in the whole.
        while k > 0 and self.text[self.ends[k - 1] - 1].isspace():
            k -= 1
        start, before = (self.ends[k - 1], self.sums[k - 1]) if k else (0, 0)
        return before + sum(map(self.bpe.counts.__getitem__, self.bpe.pieces(self.text[start:i])))

    def longest(self, limit: int) -> int:
        """The greatest i with at(i) <= limit."""
        k = bisect.bisect_right(self.sums, limit)
        if k == len(self.cut):
            return self.ends[-1] if self.ends else 0
        start = self.ends[k] - len(self.cut[k])
        # Inside a piece of one token only white space can make a beginning cheaper, joined to what is before.
        one = self.bpe.counts[self.cut[k]] == 1
        return next((i for i in range(self.ends[k] - 1, start, -1) if (not one or self.text[i - 1].isspace()) and self.at(i) <= limit), start)


_LOADED: dict[str, PrefixBpe] = {}


def counted(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document row; and fit_chars, the length of its longest prefix within the limit."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _LOADED.get(path) or _LOADED.setdefault(path, PrefixBpe(path))
        for b in batches:
            found = [bpe.fit(t.as_py(), limit) for t in b.column(2)]
            n, fit = (pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, fit], names=["doc_id", "n_bytes", "n_tokens", "fit_chars"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, fit_chars long").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars"
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
