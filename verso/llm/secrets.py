"""Secret scans: a linear-chain conditional random field over tokens, decoded by Viterbi.

Tokens are tagged as begin of a secret, inside one, or outside, from their own
shape, the neighbouring words and features of the whole text. The field is
trained here, by its exact likelihood, on generated lines whose filler words
come from a bounded sample of the corpus. Fixed patterns find the secrets of
known form; the field adds those of other forms.

Decoding is exact: a token whose outside score leads by more than any
transition could make up is outside in every best path, so the text falls into
short independent segments around the others.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.llm.common import pieces, table

#: Patterns of known form, their least length and the group that it counts.
_NAME = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
PATTERNS = (
    ("assign", re.compile(rf"({_NAME})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # a run of the class is taken whole
)
KINDS = {"assign": 0, "access": 1, "hex": 2, "field": 3}

TOKEN = re.compile(r"[A-Za-z0-9_+/.\-\x80-\U0010ffff]+|[^\sA-Za-z0-9_+/.\-\x80-\U0010ffff]")
TAGS = B, I, O = 0, 1, 2
_NAMES = re.compile(r"(?i)pass|secret|token|key|credential|auth|bearer|private")
_PLAIN = re.compile(r"[A-Za-z\x80-\U0010ffff][a-z\x80-\U0010ffff]*\.?")
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|sk[_-]|pk_|xox[abp]-|eyJ|AIza|glpat-")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words, numbers and numbered words, joined by signs or by capitals: names of files, versions and identifiers.
_COMPOSED = re.compile(r"[/._-]*([A-Z]?[a-z]{2,}\d{0,4}|[A-Z]{2,}|v?\d{1,8}|[a-z])([/._-]+([A-Z]?[a-z]+\d{0,4}|[A-Z]+|v?\d{1,8})|[A-Z][a-z]+\d{0,4})+[/._-]*")
N_TYPE, N_DOC = 24, 3


def shape(token: str) -> list[float]:
    """Features of a token by itself."""
    n = len(token)
    digits = sum("0" <= c <= "9" for c in token)
    upper = sum("A" <= c <= "Z" for c in token)
    lower = sum("a" <= c <= "z" for c in token)
    other = sum(c > "\x7f" for c in token)
    turns = sum((a.isdigit() != b.isdigit()) for a, b in zip(token, token[1:]))
    entropy = -sum(p * math.log2(p) for p in (token.count(c) / n for c in set(token))) if digits and n >= 8 else 0.0
    word = n > 1
    return [
        1.0,
        float(word and n >= 8),
        float(n >= 12),
        float(n >= 16),
        float(n >= 20),
        float(n >= 32),
        float(word and digits > 0 and upper + lower > 0),
        float(word and digits >= 3 and upper + lower >= 3),
        float(word and digits == n),
        float(word and upper > 1 and lower > 1 and n >= 8),
        float(word and upper > 1 and digits > 1 and not lower),
        min(turns, 8) / 8,
        min(entropy, 5.0) / 5,
        float(other > 0),
        float(token in "=:"),
        float(token in "\"'`"),
        float(not word and not token.isalnum()),
        float(_NAMES.search(token) is not None),
        float(_PREFIX.match(token) is not None),
        float(digits == 0 and upper <= 1 and word),
        float(_UUID.fullmatch(token) is not None),
        float(_COMPOSED.fullmatch(token) is not None),
        float(token.startswith("//")),
        float(token == "@"),
    ]


def kind_of(token: str) -> str | tuple[int, bool]:
    """What stands for a token: plain words of like length have the same features, whatever their letters."""
    if _PLAIN.fullmatch(token) and not _NAMES.search(token) and not _PREFIX.match(token):
        n = len(token)
        return (n > 1) + (n >= 8) + (n >= 12) + (n >= 16) + (n >= 20) + (n >= 32), not token.isascii()
    return token


def doc_features(n_tokens: int, n_equals: int, n_chars: int) -> list[float]:
    """Features of the whole text: how much of it is assignments, and how long it is."""
    return [min(1.0, 20.0 * n_equals / max(1, n_tokens)), float(n_tokens < 30), float(n_chars > 5000)]


@dataclass
class Field:
    """Weights of a trained field: of token features at each offset, text features and transitions."""

    offsets: tuple[int, ...] = (0, -1, -2, -3, 1)
    token: np.ndarray = field(default_factory=lambda: np.zeros((5, N_TYPE, 3)))
    doc: np.ndarray = field(default_factory=lambda: np.zeros((N_DOC, 3)))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))

    def lead(self) -> np.ndarray:
        """By how much the score of outside must lead that of begin or inside to hold in any best path."""
        t = self.trans
        return np.array([max(t[p, x] + t[x, n] - t[p, O] - t[O, n] for p in TAGS for n in TAGS) for x in (B, I)])


def _arrays(lines: list[tuple[list[str], list[int]]], offsets: tuple[int, ...]):
    """Padded feature arrays of training lines."""
    longest = max(len(t) for t, _ in lines)
    x = np.zeros((len(lines), longest, len(offsets), N_TYPE))
    d = np.zeros((len(lines), N_DOC))
    y = np.full((len(lines), longest), -1)
    for i, (tokens, tags) in enumerate(lines):
        rows = np.array([shape(t) for t in tokens])
        for k, o in enumerate(offsets):
            for j in range(len(tokens)):
                if 0 <= j + o < len(tokens):
                    x[i, j, k] = rows[j + o]
        d[i] = doc_features(len(tokens), sum(t in "=:" for t in tokens), sum(map(len, tokens)))
        y[i, : len(tags)] = tags
    return x, d, y


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(lines: list[tuple[list[str], list[int]]], rounds: int = 100, rate: float = 0.2, decay: float = 1e-3) -> Field:
    """Maximise the regularised conditional likelihood of the tags by forward-backward and Adam."""
    model = Field()
    x, d, y = _arrays(lines, model.offsets)
    n, longest = y.shape
    flat = x.reshape(n * longest, -1)
    real = y >= 0
    gold = np.eye(3)[np.where(real, y, 0)] * real[..., None]
    pairs = real[:, 1:, None, None] * gold[:, :-1, :, None] * gold[:, 1:, None, :]
    params = [model.token, model.doc, model.trans]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        e = (flat @ model.token.reshape(-1, 3)).reshape(n, longest, 3) + (d @ model.doc)[:, None, :]
        t = model.trans
        alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        alpha[:, 0] = e[:, 0] + t[O]  # what stands before a text counts as outside
        for j in range(1, longest):
            go = _logsum(alpha[:, j - 1, :, None] + t[None], 1) + e[:, j]
            alpha[:, j] = np.where(real[:, j, None], go, alpha[:, j - 1])
        z = _logsum(alpha[:, -1], 1)
        for j in range(longest - 2, -1, -1):
            go = _logsum(t[None] + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(real[:, j + 1, None], go, 0.0)
        post = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        edge = np.exp(alpha[:, :-1, :, None] + t[None, None] + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        diff = gold - post
        g = [(flat.T @ diff.reshape(-1, 3)).reshape(model.token.shape), d.T @ diff.sum(1), (pairs - edge).sum((0, 1))]
        g[2][O] += diff[:, 0].sum(0)
        for i, p in enumerate(params):
            grad = g[i] / n - decay * p
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.99 * v[i] + 0.01 * grad**2
            p += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return model


def example_lines(words: list[str], count: int = 1200, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Tagged lines: filler words with secrets of many forms, and with numbers, links, dates and names that are none."""
    rng = random.Random(seed)
    words = words or ["the", "of", "and"]
    hexa, mixed, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def draw(letters: str, least: int, most: int) -> str:
        while True:
            out = "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
            if any(c.isdigit() for c in out) and any(c.isalpha() for c in out):
                return out

    def value() -> str:
        return rng.choice((lambda: draw(hexa, 18, 48), lambda: draw(mixed, 16, 48), lambda: "AKIA" + draw(upper, 16, 16), lambda: rng.choice(("ghp_", "sk_live_", "xoxb-", "glpat-")) + draw(mixed, 20, 36), lambda: draw(mixed + "+/", 24, 44)))()

    def short() -> str:
        """A value that only its surroundings give away."""
        return rng.choice((lambda: draw(mixed, 6, 15), lambda: (rng.choice(words) + str(rng.randint(1, 999)) + rng.choice(words)).lower().replace(",", "").replace(".", "")))()

    def plain() -> str:
        return rng.choice(
            (
                lambda: "-".join("".join(rng.choice(hexa) for _ in range(n)) for n in (8, 4, 4, 4, 12)),
                lambda: "".join(rng.choice(words).title() for _ in range(rng.randint(3, 5))).replace(",", "").replace(".", "") + str(rng.randint(1, 999)),
                lambda: f"{rng.choice(words).lower()}_20{rng.randint(10, 30)}_{rng.choice(words).lower()}_v{rng.randint(1, 9)}.{rng.choice(('pdf', 'csv', 'py', 'tar.gz'))}",
                lambda: f"/{rng.choice(words).lower()}/{rng.choice(words).lower()}{rng.randint(1, 99)}/{rng.choice(words).lower()}.{rng.choice(('txt', 'html', 'log'))}",
                lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}-{rng.choice(('beta', 'rc'))}{rng.randint(1, 9)}",
                lambda: f"{rng.choice(words)[:3].upper()}{rng.randint(1, 999)} {rng.choice('ABCDE')}{rng.randint(1, 99)} {rng.randint(1, 12)}th {rng.randint(1, 99)}kg",
                lambda: f"{rng.choice(('the password', 'this token', 'a key', 'my secret'))} is {rng.choice(words)} {rng.choice(words)}",
                lambda: f"https://{rng.choice(words).lower()}:{rng.randint(80, 9999)}/{rng.choice(words).lower()}",
                lambda: str(rng.randint(0, 99999)),
                lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
                lambda: f"https://{rng.choice(words).lower()}.example.com/{rng.choice(words).lower()}/{rng.randint(1, 999)}",
                lambda: f"20{rng.randint(10, 30)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
                lambda: f"{rng.choice(words).lower()}.{rng.choice(words).lower()}@example.org",
                lambda: f"{rng.choice(words).lower()}{rng.choice(('.', '_', '-', ''))}{rng.randint(1, 9999)}@mail{rng.randint(1, 99)}.example.com",
                lambda: f"{rng.choice(words)}{rng.randint(1, 2030)} {rng.randint(1, 31)}.{rng.randint(1, 12)}.20{rng.randint(10, 30)} 192.168.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
                lambda: rng.choice(words).title() + rng.choice(words).title(),
                lambda: f"{rng.choice(words)} = {rng.randint(1, 50)};",
                lambda: f"{rng.choice(('password', 'token', 'key'))} {rng.choice(words)}",
                lambda: "".join(rng.choice(words).lower() for _ in range(4)),
                lambda: f"{rng.choice(words)}: {rng.choice(words)} | {rng.choice(words)}",
                lambda: f"{rng.choice(words)}{rng.choice(('***', '%%%', '&&&', '$$$', '###'))}",
            )
        )()

    lines = []
    for i in range(count):
        tokens: list[str] = []
        tags: list[int] = []

        def add(text: str, secret: bool = False) -> None:
            new = TOKEN.findall(text)
            tokens.extend(new)
            tags.extend([B] + [I] * (len(new) - 1) if secret and new else [O] * len(new))

        for _ in range(rng.randint(1, 3)):
            add(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))))
            if i % 4 == 0 and rng.random() < 0.5:
                if rng.random() < 0.35:
                    add(rng.choice(("postgres", "https", "mysql", "ftp", "redis")) + "://" + rng.choice(("admin", "root", rng.choice(words).lower())) + ":")
                    add(short(), True)
                    add("@" + rng.choice(words).lower() + ".example.com")
                else:
                    add(rng.choice(("db.pass =", "token is", "the password is", "password", "passwd :", "secret key:", "auth_token=", "credential :=", "pass:", "private key is")))
                    add(short(), True)
            elif i % 2 == 0:
                q = rng.choice(("", "", '"', "'"))
                add(rng.choice(("", "key", "auth_token", "Authorization", "client_secret", "credential", "private key", "Bearer", "db.pass", "api-key")) + rng.choice((" = ", ": ", "=", " ", " := ")) + q)
                add(value(), True)
                add(q)
            else:
                add(plain())
            add(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))))
        if tokens:
            lines.append((tokens, tags))
    return lines


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    for kind, pattern, group, least in PATTERNS:
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[0], KINDS[s[2]]))


class Tagger:
    """Decodes texts with a field; token types met before are remembered, up to a bound."""

    def __init__(self, model: Field, remember: int = 400_000):
        self.model, self.remember, self.lead = model, remember, model.lead()
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.kinds: dict[str | tuple[int, bool], int] = {}
        self.scores = np.zeros((0, len(self.model.offsets), 3))

    def _types(self, tokens: list[str]) -> np.ndarray:
        ids = self.ids
        if len(ids) > self.remember:
            self.clear()
            ids = self.ids
        fresh = set(tokens).difference(ids)
        for t in fresh:
            kind = kind_of(t)
            if (at := self.kinds.get(kind)) is None:
                at = self.kinds[kind] = len(self.kinds)
                if at == len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros((max(1024, at), *self.scores.shape[1:]))])
                self.scores[at] = np.array(shape(t)) @ self.model.token
            ids[t] = at
        return np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))

    def tags(self, tokens: list[str], n_chars: int) -> np.ndarray:
        """The best tag sequence of one text."""
        n = len(tokens)
        tags = np.full(n, O, np.int8)
        if not n:
            return tags
        t, ids = self.model.trans, self._types(tokens)
        e = np.tile(np.array(doc_features(n, tokens.count("=") + tokens.count(":"), n_chars)) @ self.model.doc, (n, 1))
        for k, o in enumerate(self.model.offsets):
            if abs(o) < n:
                here, there = slice(max(0, -o), n - max(0, o)), slice(max(0, o), n - max(0, -o))
                e[here] += self.scores[ids[there], k]
        open_ = np.flatnonzero(((e[:, O, None] - e[:, :O]) <= self.lead).any(1))
        if not len(open_):
            return tags
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            first, last = run[0], run[-1]
            best, back = t[O] + e[first], []
            for j in range(first + 1, last + 1):
                go = best[:, None] + t
                back.append(go.argmax(0))
                best = go.max(0) + e[j]
            if last + 1 < n:
                best = best + t[:, O]
            tag = int(best.argmax())
            tags[last] = tag
            for j in range(last - 1, first - 1, -1):
                tag = int(back[j - first][tag])
                tags[j] = tag
        return tags

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """``(start, end, 'field')`` of the tagged secrets."""
        tokens = TOKEN.findall(text)
        tags = self.tags(tokens, len(text))
        if (tags == O).all():
            return []
        out: list[tuple[int, int, str]] = []
        for m, tag in zip(TOKEN.finditer(text), tags):
            if tag == I and out and out[-1][1] == m.start():
                out[-1] = (out[-1][0], m.end(), "field")
            elif tag != O:
                out.append((m.start(), m.end(), "field"))
        return out


def all_spans(text: str, tagger: Tagger) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and these with the spans of the field that lie in none of them."""
    base = base_spans(text)
    more = [s for s in tagger.spans(text) if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS[s[2]]))


def fit(docs: DataFrame, sample_rows: int = 200, words_per_row: int = 40) -> Field:
    """A field trained on generated lines.

    Their filler is the first ``words_per_row`` words within the first 2,000
    code points of at most ``sample_rows`` texts, chosen by the digest of
    their id; these bound the sample of training words and nothing else.
    """
    ids = [r[0] for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()]
    rows = docs.filter(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).select("doc_id", F.substring("text", 1, 2000).alias("text")).orderBy("doc_id", "text").limit(sample_rows).collect()
    words = [w for r in rows for w in re.findall(r"[^\W\d_]+[.,]?", r["text"])[:words_per_row]]
    return train(example_lines(words))


def scan_secrets(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """One row a document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Null and empty texts have no spans; repeated rows are scanned alike; texts
    are scanned whole. Other columns are ignored.
    """
    model = model or fit(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def show(spans: list[tuple[int, int, str]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in pieces(batches):
            found = [all_spans(text, tagger) for text in batch.column(1).to_pylist()]
            kinds = [[k for _, _, k in base] for base, _ in found]
            columns = [pa.array([k.count(name) for k in kinds], pa.int64()) for name in ("assign", "access", "hex")]
            columns += [pa.array([hashlib.sha256(show(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([show(spans) for _, spans in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(look, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, model: Field | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``, spans that overlap by one.

    All columns and rows stay; null and empty texts are as before; repeated
    rows are treated alike; texts are read whole; an empty table stays empty.
    """
    model = model or fit(docs)
    schema = docs.schema

    def clean(text: str, tagger: Tagger) -> str:
        _, spans = all_spans(text, tagger)
        out, at = [], 0
        for a, b, _ in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:] if spans else text

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in pieces(batches):
            at = batch.schema.get_field_index("text")
            texts = [None if x is None else clean(x, tagger) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(look, schema)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Spans of every document; null, empty, repeated and long texts and empty tables as in ``scan_secrets``."""
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
