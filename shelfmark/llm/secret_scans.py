"""Secret scans: a linear-chain conditional random field over the tokens of a text.

Tokens get tags: outside, begin or inside of a secret. Features are the token's shape (length, kinds of
characters, letter-to-digit changes, variety), the words before it and the marks between, and facts of
the file (share of digits, length). Weights are fitted on a bounded sample of texts, with spans of three
sure patterns as labels and the rest of the sample as counter-examples; they find secrets that no pattern
names, such as a pass phrase after a word that stands before known secrets elsewhere.

Every token of eight or more characters may be a secret, whatever it is made of; shorter ones can only be
outside. They cut a text into runs that don't influence each other (a run starts and ends beside an outside
tag), so Viterbi decodes each run by itself and gives the best path of the whole text, however long it is.
Runs in which no context could make up for the tokens are passed over. Texts are independent: no shuffle, no
hot group.

A null text counts as an empty one without spans. Rows that repeat get equal spans. Extra columns are left
alone; a column named like the result is replaced. Where the sample has no secrets, only the patterns speak.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import materialize


#: Texts that the field is fitted on, at most so many with pattern spans and so many without.
SAMPLE_TEXTS = 400
#: Characters of a sampled text around a span that are looked at, half of them on either side.
SAMPLE_WINDOW = 400
#: Of longer spans so many characters are sampled; the features tell no lengths over 255 apart.
SAMPLE_SPAN = 1000
FIT_ROUNDS = 60
#: Shorter tokens aren't secrets.
MIN_TOKEN = 8

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=@-]")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=@-]{%d,}" % MIN_TOKEN)
_HEX_LETTERS = frozenset("abcdef")
_WORD = re.compile(r"[^\s=:\"'(]+")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the three patterns by start, then kind; leftmost and without overlaps in each kind."""
    out: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return _ordered(out)


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _runs(text: str) -> list[tuple[list[tuple[int, int]], bool]]:
    """Runs of neighbouring tokens that may be secrets, and whether a shorter token, which is outside,
    stands behind each."""
    runs: list[tuple[list[tuple[int, int]], bool]] = []
    run: list[tuple[int, int]] = []
    end = 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        if run and a - end > 1 and _TOKEN.search(text, end, a):
            runs.append((run, True))
            run = []
        end = b
        token = m[0]
        # a name stuck to its value, as in key=value, is a token of its own
        cut = max(token.rstrip("=").rfind("="), 0) if "=" in token else 0
        for a, b in ((a, a + cut), (a + cut + 1, b)) if cut else ((a, b),):
            b = a + len(text[a:b].rstrip(".="))
            if b - a >= MIN_TOKEN:
                run.append((a, b))
            elif run and b > a:
                runs.append((run, True))
                run = []
    if run:
        runs.append((run, _TOKEN.search(text, end) is not None))
    return runs


def _log2_step(n: int) -> int:
    return min(int(math.log2(n + 1)), 8)


def _token_features(token: str) -> list[str]:
    n = len(token)
    digits, uppers = sum(c.isdigit() for c in token), sum(c.isupper() for c in token)
    lowers = sum(c.islower() for c in token)
    changes = sum(x.isdigit() != y.isdigit() for x, y in zip(token, token[1:]))
    kinds = ("d" if digits else "") + ("u" if uppers else "") + ("l" if lowers else "")
    other = n - digits - uppers - lowers
    return [
        "bias",
        f"length={_log2_step(n)}",
        f"kinds={kinds}{'o' if other else ''}",
        f"digits={digits * 4 // n}",
        f"changes={min(changes * 8 // n, 4)}",
        f"variety={len(set(token)) * 4 // n}",
        f"hex={all(c in '0123456789abcdef' for c in token)}",
        f"start={token[:4] if token[:4].isupper() else '-'}",
        f"marks={'@' in token}{'.' in token}{'-' in token}",
    ]


#: Kinds of features that depend on where a token stands.
_PLACED = ("gap=", "word=", "word2=", "file_length=", "file_mark=")


def _place_features(text: str, a: int) -> list[str]:
    before = text[max(0, a - 40) : a]
    words = _WORD.findall(before)
    gap = before[len(before.rstrip(" =:\"'(")) :]
    return [
        f"gap={'=' in gap}{':' in gap}{len(gap) > 1}",
        f"word={words[-1].lower() if words else '-'}",
        f"word2={words[-2].lower() if len(words) > 1 else '-'}",
    ]


def _features(text: str, a: int, b: int, facts: tuple[str, ...]) -> list[str]:
    return [*_token_features(text[a:b]), *_place_features(text, a), *facts]


def _facts(text: str) -> tuple[str, ...]:
    return (f"file_length={_log2_step(len(text) // 64)}", f"file_mark={'{' in text or ';' in text}")


@dataclass
class Field:
    """Weights by feature for the tags outside, begin, inside, and for their succession."""

    weights: dict[str, np.ndarray]
    steps: np.ndarray
    _seen: dict[str | tuple[int, int, bool], tuple[np.ndarray, bool]] = field(default_factory=dict, repr=False, compare=False)
    _most: float | None = field(default=None, repr=False, compare=False)

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        none = np.zeros(3)
        return np.array([sum((self.weights.get(f, none) for f in r), np.zeros(3)) for r in rows])

    def tags(self, rows: list[list[str]]) -> list[int]:
        """The best path (Viterbi); a run starts after an outside tag."""
        return self._path(self.emissions(rows), False)

    def _path(self, score: np.ndarray, closed: bool) -> list[int]:
        """The best path; of a closed run, one that an outside tag follows."""
        best, back = score[0] + self.steps[0], []
        for e in score[1:]:
            paths = best[:, None] + self.steps
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + e
        if closed:
            best = best + self.steps[:, 0]
        tag = int(best.argmax())
        out = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            out.append(tag)
        return out[::-1]

    def _gain(self) -> float:
        """What a token's place and the steps beside it can add to a secret's tag over outside, at most."""
        most = dict.fromkeys(_PLACED, 0.0)
        for f, w in self.weights.items():
            kind = f[: f.find("=") + 1]
            if kind in most:
                most[kind] = max(most[kind], float(w[1:].max() - w[0]))
        return sum(most.values()) + 2 * max(float((self.steps - self.steps[0, 0]).max()), 0.0)

    def _of_token(self, token: str) -> tuple[np.ndarray, bool]:
        """The token's own share of the score, and whether some place could make it a secret."""
        key: str | tuple[int, int, bool] = token
        if token.isalpha() and token.islower():  # plain words differ in little
            letters = set(token)
            key = len(token), len(letters) * 4 // len(token), letters <= _HEX_LETTERS
        told = self._seen.get(key)
        if told is None:
            if self._most is None:
                self._most = self._gain()
            score = self.emissions([_token_features(token)])[0]
            told = score, bool(score[1:].max() - score[0] + self._most >= 0)
            if len(token) <= 64:
                if len(self._seen) >= 50_000:
                    self._seen.clear()
                self._seen[key] = told
        return told

    def spans(self, text: str) -> list[Span]:
        found: list[Span] = []
        if not self.weights:
            return found
        facts = None
        for run, closed in _runs(text):
            own = [self._of_token(text[a:b]) for a, b in run]
            if not any(may for _, may in own):
                continue
            facts = _facts(text) if facts is None else facts
            placed = self.emissions([[*_place_features(text, a), *facts] for a, _ in run])
            tags = self._path(placed + np.array([score for score, _ in own]), closed)
            for i, ((a, b), tag) in enumerate(zip(run, tags)):
                if tag == 2 and i and tags[i - 1] != 0:
                    found[-1] = ("crf", found[-1][1], b)
                elif tag:
                    found.append(("crf", a, b))
        return found


#: After outside no inside may come.
_BARRED = np.array([[0.0, 0.0, -1e9], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])


def _labelled(text: str) -> list[tuple[list[list[str]], list[int], bool]]:
    """Runs of a text as features and tags, and whether they are closed; a token inside a pattern span is
    a secret, but not the name that an assignment starts with."""
    spans = [(_ASSIGN.match(text, a).start(2) if k == "assign" else a, b) for k, a, b in base_spans(text)]
    facts, out = _facts(text), []
    for run, closed in _runs(text):
        tags, last = [], None
        for a, b in run:
            inside = next((s for s in spans if s[0] <= a and b <= s[1] + 1), None)
            tags.append(0 if inside is None else 2 if inside == last else 1)
            last = inside
        out.append(([_features(text, a, b, facts) for a, b in run], tags, closed))
    return out


def fit_field(texts: list[str], rounds: int = FIT_ROUNDS, l2: float = 0.3) -> Field:
    """Maximum likelihood with a quadratic penalty, by scaled gradient steps over the whole sample."""
    runs = [r for t in texts for r in _labelled(t)]
    names = {f: i for i, f in enumerate(sorted({f for rows, _, _ in runs for r in rows for f in r}))}
    if not any(t for _, tags, _ in runs for t in tags):
        return Field({}, _BARRED)
    alike: dict[tuple[int, bool], list] = {}
    for rows, tags, closed in runs:
        alike.setdefault((len(tags), closed), []).append(([[names[f] for f in r] for r in rows], tags))
    data = [
        (closed, np.array([at for at, _ in some]), np.array([tags for _, tags in some]))
        for (_, closed), some in alike.items()
    ]
    w, steps = np.zeros((len(names), 3)), np.zeros((3, 3))

    def gradient(w: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gw, gs = l2 * w, l2 * steps
        s = steps + _BARRED
        for closed, at, tags in data:  # runs of one length at once
            e = w[at].sum(axis=2)
            n = tags.shape[1]
            ahead, behind = np.zeros(e.shape), np.zeros(e.shape)
            ahead[:, 0] = e[:, 0] + s[0]
            for i in range(1, n):
                ahead[:, i] = e[:, i] + np.logaddexp.reduce(ahead[:, i - 1, :, None] + s, axis=1)
            if closed:
                behind[:, -1] = s[:, 0]
            for i in range(n - 2, -1, -1):
                behind[:, i] = np.logaddexp.reduce(s + (e[:, i + 1] + behind[:, i + 1])[:, None], axis=2)
            z = np.logaddexp.reduce(ahead[:, -1] + behind[:, -1], axis=1)[:, None]
            p = np.exp(ahead + behind - z[:, None])
            pair = np.zeros((3, 3))
            pair[0] += p[:, 0].sum(axis=0)
            for i in range(1, n):
                both = ahead[:, i - 1, :, None] + s + (e[:, i] + behind[:, i] - z)[:, None]
                pair += np.exp(both).sum(axis=0)
            path = np.pad(tags, ((0, 0), (1, 1 if closed else 0)))
            if closed:
                pair[:, 0] += p[:, -1].sum(axis=0)
            np.add.at(pair, (path[:, :-1].ravel(), path[:, 1:].ravel()), -1)
            gs += pair
            p -= np.eye(3)[tags]
            for t in range(3):
                share = np.repeat(p[:, :, t].ravel(), at.shape[2])
                gw[:, t] += np.bincount(at.ravel(), share, len(w))
        return gw, gs

    # steps scaled by running means of the gradient and its square, smaller towards the end
    means = [np.zeros((2, *w.shape)), np.zeros((2, *steps.shape))]
    for k in range(1, rounds + 1):
        for x, g, m in zip((w, steps), gradient(w, steps), means):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.02 * (g * g - m[1])
            fresh = m[0] / (1 - 0.9**k), m[1] / (1 - 0.98**k)
            x -= 0.3 * (1 - k / (rounds + 1)) * fresh[0] / (np.sqrt(fresh[1]) + 1e-8)
    return Field({f: w[i] for f, i in names.items()}, steps + _BARRED)


#: The three patterns as Spark has them, with the least lengths that ``base_spans`` asks for.
_SURE = (
    r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}"
    r"|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}"
)
_WITH_DIGIT = r"[0-9][A-Za-z0-9+/_.=@-]{%d,}" % (MIN_TOKEN - 1)
_ANY_LONG = r"[A-Za-z0-9+/_.=@-]{%d,}" % MIN_TOKEN


def sample_texts(docs: DataFrame, text: str = "text", size: int = SAMPLE_TEXTS) -> list[str]:
    """A bounded sample to fit on: texts with pattern spans, cut to a window around the first of them, and
    texts with other long tokens, cut around the first that has a digit, or else the first. Copies of a text
    count once. Each task offers a bounded number; the smallest hashes win."""
    def first(pattern: str) -> Column:
        return F.regexp_substr("body", F.lit(pattern))

    sure = docs.select(F.col(text).cast("string").alias("body")).select("body", first(_SURE).alias("sure"))
    found = sure.select(
        "body", F.col("sure").isNotNull().cast("int").alias("kind"),
        F.coalesce("sure", first(_WITH_DIGIT), first(_ANY_LONG)).alias("span"),
    )
    # the leftmost match is where its characters stand first; places are code points
    start = F.expr("instr(body, span)") - SAMPLE_WINDOW // 2
    length = F.least(F.length("span"), F.lit(SAMPLE_SPAN)) + F.least(start - 1, F.lit(0)) + SAMPLE_WINDOW
    told = found.select(
        "kind", F.xxhash64("body").alias("h"),
        F.when(F.col("span").isNotNull(), F.substring("body", F.greatest(start, F.lit(1)), length)).alias("window"),
    )

    def offered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            batch = batch[batch["window"].notna()]
            both = batch if kept is None else pd.concat([kept, batch])
            both = both.sort_values(["kind", "h"], kind="stable").drop_duplicates(["kind", "h"])
            kept = both.groupby("kind").head(size)
        if kept is not None:
            yield kept

    few = materialize(told.mapInPandas(offered, "kind int, h long, window string").dropDuplicates(["kind", "h"]))
    out: list[str] = []
    for kind in (1, 0):
        rows = few.filter(F.col("kind") == kind).orderBy("h").limit(size).collect()
        out += [r["window"] for r in rows]
    return out


def fit(docs: DataFrame, text: str = "text", size: int = SAMPLE_TEXTS) -> Field:
    """A field for ``docs``, from a bounded sample of them. Runs jobs at once."""
    return fit_field(sample_texts(docs, text, size))


def all_spans(text: str, field: Field) -> list[Span]:
    """Pattern spans and the field's own; of the latter those that overlap no pattern span."""
    base = base_spans(text)
    own = [s for s in field.spans(text) if all(s[2] <= b[1] or b[2] <= s[1] for b in base)]
    return _ordered(base + own)


def find_secrets(text: Column, field: Field) -> Column:
    """``array<struct<kind,start,end>>`` by start, then kind."""
    kind = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(kind)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [[{"kind": k, "start": a, "end": b} for k, a, b in all_spans(x or "", field)] for x in texts]
            )

    return scan(text)


def _redacted(text: str, field: Field, mark: str) -> str:
    out, at = [], 0
    for _, a, b in all_spans(text, field):
        if b > at:
            out += [text[at : max(a, at)], mark if a >= at else ""]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``, overlapping ones by one, and
    ``n_chars``, where there is one, to match. A null text stays null."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if x is None else _redacted(x, field, mark) for x in texts], dtype=object)

    out = docs.withColumn(text, clean(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out
