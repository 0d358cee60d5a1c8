"""Secrets by grammar inference.

One probabilistic automaton per credential format is inferred from labelled credentials: the examples form a prefix
tree with counts, and states whose outgoing frequencies agree by Hoeffding's bound are merged, with their subtrees
folded into each other (red-blue order), until no two states are compatible. A further automaton is inferred from
ordinary identifiers. Every candidate of a text is scored by its best format's log2 likelihood ratio per character
against the ordinary automaton: each maximal run of credential characters, and where a run is no secret as a whole, its
parts between ``=``, then ``/``, then ``.``. What is shorter than the shortest labelled credential is no candidate.

Labelled credentials are a parameter; by default they are drawn from publicly documented formats with a fixed seed.
Training takes at most ``max_examples`` examples a format; it reads no table, and every text is scanned in one narrow
pass. Base kinds (leftmost, non-overlapping per kind, failing matches dropped): assign, access, hex. The method adds
``format`` spans; base spans stay without a score.

Null text is empty; an empty text has no spans; long texts are scanned whole; rows with equal ids are scanned one by one;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "format")
THRESHOLD = 0.75

_CLASSES = {
    **dict.fromkeys("abcdef", ("a", 6)),
    **dict.fromkeys("ghijklmnopqrstuvwxyz", ("g", 20)),
    **dict.fromkeys("ABCDEF", ("A", 6)),
    **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", ("G", 20)),
    **dict.fromkeys("0123456789", ("0", 10)),
}
#: The first characters of a credential are symbols of their own, so that fixed prefixes are learned; then classes.
PREFIX = 5
_KEEP_LITERAL = 1e-3

_LOWER, _UPPER, _NUM = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Publicly documented credential formats as (label, fixed prefix, alphabet, least and greatest length of the rest).
FORMATS = (
    ("hosting_token", "ghp_", _LOWER + _UPPER + _NUM, 36, 36),
    ("access_key", "AKIA", _UPPER + _NUM, 16, 16),
    ("maps_key", "AIza", _LOWER + _UPPER + _NUM + "-_", 35, 35),
    ("chat_token", "xoxb-", _NUM + _LOWER + _UPPER + "-", 40, 60),
    ("payment_key", "sk_live_", _LOWER + _UPPER + _NUM, 24, 32),
    ("web_token", "eyJ", _LOWER + _UPPER + _NUM + "-_.", 60, 160),
    ("package_token", "npm_", _LOWER + _UPPER + _NUM, 36, 36),
    ("mail_key", "SG.", _LOWER + _UPPER + _NUM + "-_.", 60, 66),
    ("hex_digest", "", "0123456789abcdef", 32, 64),
    ("random_base64", "", _LOWER + _UPPER + _NUM + "+/", 32, 64),
)
_ORDINARY = (
    "release-2024-01-15-final.tar.gz", "src/main/resources/config_2.json", "chapter_12_section_03.html", "2024-03-31T12:00:00",
    "node_modules/library-4.17.21", "image_0001_thumbnail.png", "version-1.20.3-beta", "user_profile_page_2", "0000000000000000",
    "1234567890123456", "www.example.org/archive/1999", "invoice_2023_000123.pdf", "the-quick-brown-fox-2", "section.4.2.1.paragraph.7",
)


def examples(n: int = 200, seed: int = 7) -> dict[str, list[str]]:
    """n labelled credentials of every public format, the same on every call."""
    r = random.Random(seed)
    return {k: [p + "".join(r.choices(chars, k=r.randint(a, b))) for _ in range(n)] for k, p, chars, a, b in FORMATS}


def ordinary(n: int = 1200, seed: int = 11) -> list[str]:
    """n ordinary identifiers: words of letters alone, compounds of words, paths, dates, versions and numbers."""
    r = random.Random(seed)
    syllables = "re tion the ing er an en on st or ment able con pre ch ou le de es la al in at ed ly ver un ge".split()
    out = list(_ORDINARY)
    while len(out) < n:
        if r.random() < 0.2:  # plain numbers and times
            out.append(str(r.randint(10**15, 10**20)) if r.random() < 0.6 else f"20{r.randint(10, 29)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}.{r.randint(0, 999)}")
            continue
        if r.random() < 0.4:  # words without digits, as long as some languages make them, or run together
            word = "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") + r.choice(["", "", "n", "r", "s", "t", "l"]) for _ in range(r.randint(2, 16)))
            out.append(r.choice([str.lower, str.lower, str.capitalize, str.upper])(word))
            continue
        parts = ["".join(r.choices(syllables, k=r.randint(1, 5))) for _ in range(r.randint(1, 5))]
        if r.random() < 0.3:
            parts = [p.capitalize() for p in parts]
        if r.random() < 0.6:
            parts.insert(r.randint(1, len(parts)), str(r.randint(0, 10 ** r.randint(1, 6))))
        site = r.choice(["", "", "", "https://www.", "http://", "www."])
        out.append((site + r.choice(["-", "_", "/", ".", ""]).join(parts))[:80])
    return out


def symbols(text: str, prefix: int = PREFIX) -> list[tuple[str, int]]:
    """(symbol, size of its class) of every character; one symbol of its own for the first few."""
    return [(("^" + c, 1) if i < prefix else _CLASSES.get(c, (c, 1))) for i, c in enumerate(text)]


class Automaton:
    """A probabilistic deterministic finite automaton inferred by merging compatible prefix-tree states."""

    def __init__(self, texts: Sequence[str], prefix: int = PREFIX, alpha: float = 0.05):
        self.total: list[int] = [0]
        self.final: list[int] = [0]
        self.edges: list[dict[str, list[int]]] = [{}]  # symbol -> [count, target]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for t in texts:
            self._add([s for s, _ in symbols(t, prefix)])
        self._infer()

    def _add(self, path: list[str]) -> None:
        at = 0
        self.total[0] += 1
        for s in path:
            edge = self.edges[at].get(s)
            if edge is None:
                edge = self.edges[at][s] = [0, len(self.total)]
                self.total.append(0)
                self.final.append(0)
                self.edges.append({})
            edge[0] += 1
            at = edge[1]
            self.total[at] += 1
        self.final[at] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether b's subtree has the frequencies of a's states; b is always the root of a tree."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self.total[a], self.total[b]
            if not n1 or not n2:
                continue
            if self._differ(self.final[a], n1, self.final[b], n2):
                return False
            for s in self.edges[a].keys() | self.edges[b].keys():
                e1, e2 = self.edges[a].get(s), self.edges[b].get(s)
                if self._differ(e1[0] if e1 else 0, n1, e2[0] if e2 else 0, n2):
                    return False
                if e1 and e2:
                    todo.append((e1[1], e2[1]))
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.final[a] += self.final[b]
            for s, (n, target) in self.edges[b].items():
                edge = self.edges[a].get(s)
                if edge is None:
                    self.edges[a][s] = [n, target]
                else:
                    edge[0] += n
                    todo.append((edge[1], target))

    def _infer(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = [(-self.total[e[1]], r, s, e[1]) for r in red for s, e in self.edges[r].items() if e[1] not in known]
            if not blue:
                break
            _, parent, symbol, state = min(blue)
            for r in red:
                if self._compatible(r, state):
                    self.edges[parent][symbol][1] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
        place = {r: i for i, r in enumerate(red)}
        self.total = [self.total[r] for r in red]
        self.final, self.edges = (
            [self.final[r] for r in red],
            [{s: [n, place[t]] for s, (n, t) in self.edges[r].items()} for r in red],
        )

    def log2(self, path: list[tuple[str, int]], floor: float = _KEEP_LITERAL) -> float:
        """log2 probability of a text; a symbol not seen in a state has probability ``floor`` and keeps the state."""
        at, score = 0, 0.0
        for s, size in path:
            edge = self.edges[at].get(s)
            if edge is None and s[0] == "^":
                kind, size = _CLASSES.get(s[1], (s[1], 1))
                edge = self.edges[at].get(kind)
            if edge is None:
                score += math.log2(floor)
            else:
                score += math.log2(edge[0] / self.total[at] / size)
                at = edge[1]
        return score + math.log2(max(self.final[at] / max(self.total[at], 1), floor))


class Model:
    """The automata of all formats and of ordinary identifiers."""

    def __init__(self, labelled: dict[str, Sequence[str]] | None = None, benign: Sequence[str] | None = None, max_examples: int = 400):
        labelled = labelled if labelled is not None else examples()
        self.formats = {k: Automaton(list(v)[:max_examples]) for k, v in labelled.items() if v}
        self.least = min((len(x) for v in labelled.values() for x in v), default=0)
        # ordinary identifiers have no fixed beginnings
        self.ordinary = Automaton(list(benign if benign is not None else ordinary())[: 3 * max_examples], prefix=0)

    def score(self, text: str) -> tuple[float, str]:
        """The best format's log2 likelihood ratio per character against ordinary identifiers, and its label."""
        if not text or not self.formats:
            return 0.0, ""
        path = symbols(text)
        plain = self.ordinary.log2(symbols(text, 0))
        best, label = max((a.log2(path), k) for k, a in self.formats.items())
        return (best - plain) / len(text), label


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: What parts a run that is no secret as a whole, in this order.
SEPARATORS = "=/."
#: A text without one of these, in lower case, has no assignment.
_HINTS = ("passw", "secret", "token", "api")


def finder(model: Model, threshold: float = THRESHOLD):
    """A function from a text to its base spans and the added spans."""
    score = functools.lru_cache(1 << 16)(lambda text: model.score(text)[0])

    def secrets(text: str, start: int, separators: str) -> list[S.Span]:
        """Spans of the secrets in a run that begins at ``start``."""
        if len(text) < model.least:
            return []
        if score(text) >= threshold:
            return [("format", start, start + len(text))]
        for i, c in enumerate(separators):
            if c in text:
                out = []
                for part in text.split(c):
                    out += secrets(part, start, separators[i + 1 :])
                    start += len(part) + 1
                return out
        return []

    def find(text: str) -> tuple[list[S.Span], list[S.Span]]:
        base: list[S.Span] = []
        low = text.lower()
        if any(h in low for h in _HINTS):
            base += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        held = {(a, b) for _, a, b in base}
        more: list[S.Span] = []
        for m in CANDIDATE.finditer(text):
            if m.end() - m.start() >= model.least:
                more += [s for s in secrets(m[0], m.start(), SEPARATORS) if s[1:] not in held]
        return base, more

    return find


def find_secrets(
    docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows (id, base, more) with arrays of structs kind, start, stop (code points, end exclusive)."""
    model = model or Model()
    return S.scan(docs, lambda: finder(model, threshold), id_column, text_column)


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each of ``find_secrets``, nulls, repeats and long texts included; see ``spans.digest``."""
    return S.digest(found, id_column, BASE, KINDS)


def redact(docs: DataFrame, model: Model | None = None, mark: str = "[SECRET]", text_column: str = "text") -> DataFrame:
    """Documents with every secret's span replaced by ``mark``; all columns and rows stay, null texts stay null.

    Overlapping spans are replaced together. A column n_chars, if there is one, becomes the new length.
    """
    import pyarrow as pa

    model = model or Model()
    place = docs.columns.index(text_column)

    def run(batches):
        find = finder(model)
        for batch in batches:
            out = []
            for text in batch.column(place).to_pylist():
                if text:
                    base, more = find(text)
                    end = len(text) + 1
                    for _, a, b in sorted([*base, *more], key=lambda s: (-s[2], s[1])):
                        if b <= end:
                            text, end = text[:a] + mark + text[b:], a
                        elif a < end:  # overlaps what was replaced: the part to its left goes too
                            text, end = text[:a] + text[end:], a
                out.append(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, type=batch.column(i).type) if i == place else batch.column(i) for i in range(batch.num_columns)],
                names=batch.schema.names,
            )

    done = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns and docs.schema["n_chars"].dataType.simpleString() in ("bigint", "int"):
        done = done.withColumn("n_chars", F.coalesce(F.length(text_column), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done
