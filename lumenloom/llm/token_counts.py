"""Token counts of whole texts by a two-tier lookup of pre-tokens, without ever shuffling the pre-tokens.

A byte-level BPE cuts a text into pre-tokens (words, numbers, marks, white space) and encodes each by itself, so a text has as many
tokens as its pre-tokens together. Two passes over the texts:

1. Every task counts its pre-tokens, in a table that drops its rarer half when it is full, and hands on the PER_TASK most frequent
   with their counts. Spark adds these few rows up; the TABLE most frequent of all, with their numbers of tokens, are the first tier:
   about a megabyte, broadcast.
2. Every task cuts its texts again and adds up. What the first tier lacks is looked up in the worker's own cache and, failing that,
   encoded by `tokenizers` once; the cache starts anew when it is full.

The first tier only decides where a number is looked up, so no result depends on it or on what a task dropped.

Pre-tokens are cut by Python's own regular expressions, on the classes of letters, numbers and white space of `tokenizers`, which a few
calls tell for all code points (PreTokens). Strings of special tokens inside a text count as their token, as is that library's default.

Defined results: a null or empty text has no bytes and no tokens; repeated documents and those without an id are counted one by one; a
text of any length is read whole, in slices of its pre-tokens; other columns pass as they are, those named like a new one are replaced.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import add_columns, tidy, worker_cached

LIMIT = 512
#: Pre-tokens of the first tier and the longest of them in characters: some 2 MB at most.
TABLE, LONGEST = 1 << 15, 64
#: Pre-tokens that a task hands on, and that it counts at once.
PER_TASK, COUNTED = 1 << 13, 1 << 18
#: Pre-tokens in a worker's cache; longer ones than LONGEST stay out.
CACHE = 1 << 17
#: Pre-tokens cut at once, and texts longer than this are cut in such slices.
SLICE, LONG_TEXT = 1 << 16, 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranges(codes: list[int]) -> str:
    """The code points as the inside of a character class."""
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


#: Planes with characters of several classes; the others hold none or private ones, class O.
PLANES = [*range(0x40000), *range(0xE0000, 0xF0000)]


#: Byte-level vocabularies write a byte as its Latin-1 character if that is printable, else as one of the characters from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
FAR = re.compile("[\U00010000-\U0010ffff]")


class PreTokens:
    """Cuts texts as a byte-level tokenizer of `tokenizers` does, special tokens included.

    patterns: those of another one for the same file (its .patterns), which saves asking for the classes again.
    """

    def __init__(self, path: str, patterns: tuple[str, str] | None = None) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        cut = told.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or told.get("normalizer"):
            raise ValueError(f"{path}: only byte-level tokenizers without prefix and normalizer cut a text into pre-tokens of their own")
        special = told.get("added_tokens") or []
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in special):
            raise ValueError(f"{path}: special tokens that depend on what is around them")
        names = sorted((re.escape(t["content"]) for t in special), key=len, reverse=True)
        self.special = re.compile("|".join(names)) if names else None
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.patterns = patterns or self._patterns(self._classes())
        self.near, self.far = map(re.compile, self.patterns)

    def _class_of(self, c: str) -> str:
        starts = {a for _, (a, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}1{c}!")}
        return "S" if c == " " else "L" if 1 not in starts else "N" if 2 not in starts else "O" if 4 not in starts else "S"

    def _classes(self) -> dict[str, list[int]]:
        """Code points by class: L letter, N number, S white space, O other.

        Unicode versions differ: what Python takes for one class is cut as one text, and where that gives more pieces than
        one, each piece's first character tells the class of the piece.
        """
        guess: dict[str, list[int]] = {"L": [], "N": [], "O": []}
        found: dict[str, list[int]] = {"L": [], "N": [], "S": [], "O": []}
        for c in PLANES:
            kind = unicodedata.category(chr(c))
            if chr(c).isspace() or kind[0] == "Z":
                found[self._class_of(chr(c))].append(c)
            elif kind != "Cs":
                guess[kind[0] if kind[0] in "LN" else "O"].append(c)
        for codes in guess.values():
            text = "".join(map(chr, codes))
            for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
                found[self._class_of(text[a])] += codes[a:b]
        return {k: sorted(v) for k, v in found.items()}

    @staticmethod
    def _patterns(found: dict[str, list[int]]) -> tuple[str, str]:
        """For texts within the basic plane and for all; the second tries a class of its own beyond that plane."""
        low = {k: _ranges([c for c in v if c <= 0xFFFF]) for k, v in found.items()}
        high = {k: _ranges([c for c in v if c > 0xFFFF]) for k, v in found.items()}
        beyond = "\\U00010000-\\U0010ffff"
        blank = f"[{low['S']}]+(?![^{low['S']}])|[{low['S']}]+"
        start = "'(?:s|t|re|ve|m|ll|d)"
        near = f"{start}| ?[{low['L']}]+| ?[{low['N']}]+| ?[^{low['S']}{low['L']}{low['N']}]+|{blank}"
        wide = [f" ?(?:[{low[k]}]+|(?=[{beyond}])[{high[k]}])+" for k in "LN"]
        other = f" ?(?:[^{low['S']}{low['L']}{low['N']}{beyond}]+|(?=[{beyond}])[^{high['L']}{high['N']}])+"
        return near, "|".join([start, *wide, other, blank])

    def cut(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text without special tokens, in order, in lists."""
        pattern = self.far if FAR.search(text) else self.near
        if len(text) < LONG_TEXT:
            yield pattern.findall(text)
            return
        found = (m[0] for m in pattern.finditer(text))
        while part := list(islice(found, SLICE)):
            yield part

    def parts(self, text: str) -> list[str]:
        """The text between special tokens: one piece more than there are tokens."""
        return self.special.split(text) if self.special else [text]

    def lengths(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token: its bytes as the letters that byte-level vocabularies are written in, then the tokenizer's model."""
        tokens = self.model.tokenize
        return [len(tokens(p.encode().decode("latin-1").translate(LETTERS))) for p in pieces]


class TwoTiers:
    """Numbers of tokens: a fixed table first, then a cache that encodes what it lacks."""

    def __init__(self, cutter: PreTokens, frequent: dict[str, int]) -> None:
        self.cutter, self.frequent, self.cache = cutter, frequent, {}

    def count(self, text: str | None) -> int:
        parts = self.cutter.parts(text or "")
        return len(parts) - 1 + sum(self._count(pieces) for part in parts for pieces in self.cutter.cut(part) if part)

    def _count(self, pieces: list[str]) -> int:
        got = list(map(self.frequent.get, pieces))
        if None not in got:
            return sum(got)
        rest = [p for p, n in zip(pieces, got) if n is None]
        return sum(filter(None, got)) + self._rest(rest)

    def _rest(self, pieces: list[str]) -> int:
        new = list({p for p in pieces if p not in self.cache})
        if not new:
            return sum(map(self.cache.__getitem__, pieces))
        known = dict(zip(new, self.cutter.lengths(new)))
        total = sum(known[p] if p in known else self.cache[p] for p in pieces)
        if len(self.cache) + len(known) > CACHE:
            self.cache.clear()
        self.cache.update((p, n) for p, n in islice(known.items(), CACHE) if len(p) <= LONGEST)
        return total


def _cutter(path: str, patterns: tuple[str, str] | None = None) -> PreTokens:
    return worker_cached(f"pre_tokens:{path}", lambda: PreTokens(path, patterns))


def frequent_pretokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """pretoken and n, most frequent first: at most TABLE of what the tasks found most often."""
    patterns = _cutter(path).patterns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = _cutter(path, patterns), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in cutter.parts(text or ""):
                    for pieces in cutter.cut(part) if part else ():
                        seen.update(pieces)
                        if len(seen) > COUNTED:
                            seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = [(p, n) for p, n in islice(sorted(seen.items(), key=lambda x: (-x[1], x[0])), 2 * PER_TASK) if len(p) <= LONGEST][:PER_TASK]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["pretoken", "n"])

    found = docs.select(text_col).mapInArrow(tidy(run), "pretoken string, n long")
    return found.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(TABLE)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, text_col: str = "text") -> DataFrame:
    """docs without its texts, plus n_bytes (UTF-8), n_tokens and over_limit (more tokens than the limit)."""
    path = path or default_tokenizer()
    top = frequent_pretokens(docs, path, text_col).select("pretoken").toArrow().column("pretoken").to_pylist()  # TABLE short strings at most
    cutter = _cutter(path)
    patterns, name = cutter.patterns, f"token_tiers:{uuid.uuid4().hex}"
    tier = docs.sparkSession.sparkContext.broadcast((top, array("H", cutter.lengths(top) if top else []).tobytes()))

    def make() -> TwoTiers:
        words, counts = tier.value
        return TwoTiers(_cutter(path, patterns), dict(zip(words, array("H", counts))))

    def compute(texts: list[str | None]) -> list[list[int]]:
        tiers = worker_cached(name, make)
        return [[tiers.count(t) for t in texts]]

    clean = docs.select(*(c for c in docs.columns if c.lower() not in {"n_bytes", "n_tokens", "over_limit"}))
    sized = clean.withColumn("n_bytes", F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long"))
    return add_columns(sized, text_col, "n_tokens long", compute).withColumn("over_limit", F.col("n_tokens") > limit)
