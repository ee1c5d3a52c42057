"""Personal data: patterns, and a skip-chain conditional random field that keeps repeated tokens consistent."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import table

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is trained on, at most, and tokens of each; probability from which a span is added; rounds of
#: messages after which a document that doesn't converge is left.
SAMPLE, TOKENS, SURE, ROUNDS = 3000, 60, 0.9, 1000
LABELS = 1 + len(KINDS)
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; from each @ backwards, so that a long run without one costs nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def patterns(text: str) -> list[Span]:
    """The base spans, by kind and then start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def shape(token: str) -> list[int]:
    """Numbers of the features that a token has; 0 is the bias."""
    digits = re.sub(r"[^0-9]", "", token)
    letters = sum(c.isalpha() for c in token)
    n = len(digits)
    sizes = (0, 1, 3, 4, 6, 8, 12, 16, 20)
    out = [0, 1 + max(i for i, s in enumerate(sizes) if n >= s)]
    parts = token.split(".")
    tests = (
        "@" in token, "@" in token and "." in token.rpartition("@")[2], token.startswith("+"), token.startswith("(") or token.endswith(")"),
        n == len(token), n > 0 and letters == 0, letters > n, len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts),
        16 <= n <= 19 and luhn(digits), "-" in token and letters == 0, "=" in token, letters > 0 and n > 8, len(token) > 30, "%" in token or "$" in token)
    return out + [10 + i for i, t in enumerate(tests) if t]


N_SHAPES = 24


class Graph:
    """Tokens of many documents: those with a digit or @, the only ones that can bear a label.

    Edges: neighbouring words (chain), and each token with a hub for all tokens of its document that are equal without case and
    punctuation, or have equal digits, equal last seven digits, or an equal name before @ (skip). So a token met k times has k edges of
    a sort, and any two occurrences are two edges apart. A hub's label is given where a pattern labels one of its tokens.
    """

    def __init__(self, texts: list[str | None]) -> None:
        self.base: list[list[Span]] = []
        self.doc, self.start, self.end, self.label, self.tokens = [], [], [], [], []
        chain, skip, self.hub_doc = [], [], []
        for d, text in enumerate(texts):
            if not text:
                self.base.append([])
                continue
            spans = patterns(text)
            self.base.append(spans)
            by_start = sorted((a, b, KINDS.index(k) + 1) for k, a, b in spans)
            met: dict[tuple[str, str], list[int]] = {}
            at, before = 0, None
            for w, m in enumerate(_WORD.finditer(text)):
                word = m[0]
                if not ("@" in word or any(c in word for c in "0123456789")):
                    continue
                a, b = m.start() + len(word) - len(word.lstrip(_EDGE)), m.start() + len(word.rstrip(_EDGE))
                if a >= b:
                    continue
                while at < len(by_start) and by_start[at][1] <= m.start():
                    at += 1
                i = len(self.doc)
                self.doc.append(d), self.start.append(a), self.end.append(b), self.tokens.append(word.strip())
                self.label.append(min((k for s, e, k in by_start[at : at + 2 * len(KINDS)] if s < b and e > a), default=0))
                if before == w - 1:
                    chain.append((i - 1, i))
                before = w
                token = text[a:b]
                digits = re.sub(r"[^0-9]", "", token)
                keys = [("same", token.lower())]
                if len(digits) >= 6:
                    keys += [("digits", digits), ("tail", digits[-7:])]
                if "@" in token:
                    keys.append(("name", token.lower().partition("@")[0]))
                for key in keys:
                    met.setdefault(key, []).append(i)
            for members in {tuple(x): None for x in met.values() if len(x) > 1}:
                skip += [(i, len(self.hub_doc)) for i in members]
                self.hub_doc.append(d)
        self.chain, self.skip = (np.array(x, int).reshape(-1, 2) for x in (chain, skip))
        self.label = np.array(self.label, int)
        self.labels = np.zeros((len(self.hub_doc), LABELS), int)
        np.add.at(self.labels, (self.skip[:, 1], self.label[self.skip[:, 0]]), 1)

    def shared(self, counts: np.ndarray) -> np.ndarray:
        """A hub's label, from counts of its tokens' labels: the most frequent one of a pattern; 0 without any."""
        return np.where(counts[:, 1:].any(axis=1), 1 + counts[:, 1:].argmax(axis=1), 0)

    def shapes(self) -> np.ndarray:
        out = np.zeros((len(self.tokens), N_SHAPES), np.float32)
        for i, t in enumerate(self.tokens):
            out[i, shape(t)] = 1
        return out


class Field:
    """Log potentials: shapes by label, chain[left, right], skip[one, other] (symmetric)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Probabilities of labels by loopy message passing; tokens inside base spans are given."""
        unary = np.concatenate([g.shapes() @ self.unary, np.zeros((len(g.hub_doc), LABELS))])
        label, doc = np.r_[g.label, g.shared(g.labels)], np.array([*g.doc, *g.hub_doc], int)
        given = label > 0
        unary[given] = -60.0
        unary[given, label[given]] = 0.0
        edges = np.concatenate([g.chain, g.skip + [0, len(g.tokens)]])
        pair = np.concatenate([np.repeat(p[None], n, 0) for p, n in ((self.chain, len(g.chain)), (self.skip, len(g.skip)))])
        n = len(edges)
        source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        both = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.r_[np.arange(n, 2 * n), np.arange(n)]
        message = np.zeros((2 * n, LABELS))
        belief = unary.astype(float)
        open_ = np.arange(2 * n)  # messages of documents that haven't converged
        for _ in range(rounds):
            if not len(open_):
                break
            x = (belief[source[open_]] - message[back[open_]])[:, :, None] + both[open_]
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.zeros(len(g.base))
            np.maximum.at(change, doc[source[open_]], np.abs(new - message[open_]).max(axis=1))
            message[open_] = 0.5 * message[open_] + 0.5 * new
            nodes = np.unique(target[open_])
            belief[nodes] = unary[nodes]
            np.add.at(belief, target[open_], message[open_])
            open_ = open_[change[doc[source[open_]]] >= 1e-3]
        belief = belief[: len(g.tokens)]
        p = np.exp(belief - belief.max(axis=1, keepdims=True)) if len(belief) else belief
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, texts: list[str | None], sure: float = SURE) -> list[tuple[list[Span], list[Span]]]:
        """For each text the base spans and the added ones: tokens outside base spans with a label that is sure."""
        g = Graph(texts)
        added: list[list[Span]] = [[] for _ in texts]
        if len(g.tokens):
            p = self.marginals(g)
            chained = {(i, j) for i, j in g.chain.tolist()}
            best, open_ = p.argmax(axis=1), None
            for i in np.flatnonzero((g.label == 0) & (best > 0) & (p.max(axis=1) >= sure)).tolist():
                d, kind = g.doc[i], KINDS[best[i] - 1]
                if kind == "phone" and open_ == (i - 1, kind) and (i - 1, i) in chained:
                    added[d][-1] = (kind, added[d][-1][1], g.end[i])
                else:
                    added[d].append((kind, g.start[i], g.end[i]))
                open_ = (i, kind)
        return list(zip(g.base, added, strict=True))


def fit(shapes: np.ndarray, left: np.ndarray, right: np.ndarray, skip: np.ndarray, label: np.ndarray, steps: int = 400) -> Field:
    """Pseudo-likelihood: each label from the token's shape and its neighbours' labels, multinomial, with an L2 penalty.

    left, right, skip: counts of neighbours' labels; a hub's is that of its other tokens. Without tokens all potentials are 0, and no span is added.
    """
    unary, pairs = np.zeros((N_SHAPES, LABELS)), np.zeros((3, LABELS, LABELS))
    if not len(label):
        unary[0, 0] = 5.0
        return Field(unary, pairs[0], pairs[1])
    x = np.concatenate([shapes, left, right, skip], axis=1).astype(float)
    y = np.eye(LABELS)[label]
    w, v = np.zeros((x.shape[1], LABELS)), 0.0
    rate = 2.0 / max(1.0, float((x**2).sum(axis=1).mean()))
    for _ in range(steps):
        s = x @ w
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        v = 0.9 * v - rate * (x.T @ (p - y) / len(y) + 1e-4 * w)
        w = w + v
    a, b, c = (w[N_SHAPES + k * LABELS : N_SHAPES + (k + 1) * LABELS] for k in range(3))
    return Field(w[:N_SHAPES], (a + b.T) / 2, (c + c.T) / 2)


def trained(docs: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Field:
    """A field fitted on the base spans of about `sample` documents with a digit or @, drawn by a hash of id and text.

    Executors send numbers of features and neighbours' labels of at most TOKENS tokens of a document, drawn by hash. Half of the tokens are shown
    without their shape, so that the weights of neighbours have to carry what a token's look doesn't tell.
    """
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    n = own.count()
    drawn = F.pmod(F.xxhash64("id", "text", F.lit("pii")), F.lit(1_000_000_000)) / 1e9
    own = own.where(drawn < (min(1.0, sample / n) if n else 1.0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = Graph(batch["text"].to_pylist())
            if not len(g.tokens):
                continue
            near = np.zeros((3, len(g.tokens), LABELS), np.int8)
            np.add.at(near[0], (g.chain[:, 1], g.label[g.chain[:, 0]]), 1)
            np.add.at(near[1], (g.chain[:, 0], g.label[g.chain[:, 1]]), 1)
            token, hub = g.skip.T
            others = g.labels[hub]
            others[np.arange(len(token)), g.label[token]] -= 1
            np.add.at(near[2], (token, g.shared(others)), 1)
            x = g.shapes()
            mark = np.array([zlib.crc32(f"{t} {i}".encode()) for i, t in enumerate(g.tokens)], np.int64)
            x[mark % 2 == 0, 1:] = 0
            rank, doc = np.empty(len(mark), int), np.array(g.doc)
            order = np.lexsort((mark, doc))
            rank[order] = np.arange(len(mark)) - np.searchsorted(doc[order], doc[order])
            kept = rank < TOKENS
            all_ = np.concatenate([x, *near, g.label[:, None]], axis=1).astype(np.int8)[kept]
            yield pa.record_batch({"row": pa.array([r.tobytes() for r in all_], pa.binary())})

    got = sorted(own.mapInArrow(rows, "row binary").toArrow()["row"].to_pylist())
    m = np.frombuffer(b"".join(got), np.int8).reshape(len(got), N_SHAPES + 3 * LABELS + 1)
    cuts = [N_SHAPES, N_SHAPES + LABELS, N_SHAPES + 2 * LABELS, N_SHAPES + 3 * LABELS]
    x, left, right, skip, y = np.split(m, cuts, axis=1)
    return fit(x, left, right, skip, y[:, 0])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), *s[1:])))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span as [KIND]; of overlapping spans the first, then the longer one."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detected(docs: DataFrame, field: Field, text: str = "text", mask: bool = False) -> DataFrame:
    """All rows and columns of docs with n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans of all.

    mask: also `masked`, the text with all spans replaced. Null texts count as empty; masked keeps them null. Whole texts are read; those without digit and @
    don't leave the JVM. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = [f"n_{k}" for k in KINDS]

    @F.arrow_udf(", ".join(f"{c} long" for c in names) + ", base_sha256 string, spans string, masked string")
    def of(x: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in range(len(names) + 3)]
        texts = x.to_pylist()
        for i in range(0, len(texts), 1000):
            for t, (base, added) in zip(texts[i : i + 1000], shared.value.spans(texts[i : i + 1000]), strict=True):
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                for to, v in zip(out, [*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined([*base, *added]), masked(t, [*base, *added]) if mask and t else None], strict=True):
                    to.append(v)
        kinds = [pa.int64()] * len(names) + [pa.string()] * 3
        return pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], [*names, "base_sha256", "spans", "masked"])

    may = F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))
    none = dict.fromkeys(names, F.lit(0).cast("long")) | {"base_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "spans": F.lit("")}
    if mask:
        none["masked"] = F.col(text)
    out = docs.drop(*none, "_may", "_found").withColumn("_may", may).withColumn("_found", of(F.when(may, F.col(text))))
    return out.withColumns({c: F.when(F.col("_may"), F.col("_found")[c]).otherwise(v) for c, v in none.items()}).drop("_may", "_found")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark).select("doc_id", "text")
    return detected(docs, trained(docs)).drop("text")
